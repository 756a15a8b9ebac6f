"""Words go down the tree of pieces together; substrings are not looked up one by one."""

import numpy as np

from framelake.llm import language
from framelake.llm.vocab import default_path


class Unasked(dict):
    def get(self, *args):
        raise AssertionError("a substring was looked up by itself")


def test_the_lattice_is_read_off_the_tree():
    v = language.Vocabulary(default_path("piece_bpe_32k.model"))
    words = ["the", "straße", "naïve", "été", "ﬀ", "𝒳", "𝒳abc", "世界", "q" * 32, "international", "x\U0010fffd", "zzzzzz", "información"]
    ids, v.ids = v.ids, Unasked(v.ids)
    for n in {len(w) for w in words}:
        some = [language.MARK + w for w in words if len(w) == n]
        got = v.lattice(some)
        top = min(n + 1, v.longest)
        want = [[[ids.get(w[end - k : end], v.other if k == 1 else v.none) if k <= end else v.none for k in range(1, top + 1)] for end in range(1, n + 2)] for w in some]
        assert got.dtype == np.int32 and got.tolist() == want
