"""Complete reports: which scans and operators make up each of them."""
