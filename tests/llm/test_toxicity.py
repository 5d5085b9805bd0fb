import numpy as np

from adlytics.llm import toxicity


def test_words_that_recur_are_rated_once():
    """A batch holds about 160,000 distinct words, most of which the batches before had, too."""
    rated = []

    class Counting:
        def margins(self, strings):
            rated.extend(strings)
            return np.zeros(len(strings))

    toxicity._CACHE.clear()
    one, other = ([f"{first}{n:06d}" for n in range(120_000)] for first in ("word", "term"))
    for words in (one, other, one, other):
        assert len(toxicity._rate(Counting(), words)) == len(words)
    toxicity._CACHE.clear()
    toxicity._CACHED_FOR.clear()
    assert len(rated) == len(set(rated)) == 2 * sum(len(toxicity.variants(w)) for w in one)
