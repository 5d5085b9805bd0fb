"""Reading input tables, saving intermediates, writing exports."""
