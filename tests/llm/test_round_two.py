"""What the second round's findings changed in the training-data operators."""

import numpy as np
import pytest

from floatweave.llm import simhash
from floatweave.llm.pretokens import ByteLevelEncoder
from floatweave.llm.queries import vocabulary


def test_members_of_many_clusters_are_joined_once(spark, monkeypatch):
    """Six members in eight clusters: prints and sets are joined to six rows, not to 48, and no edge is lost."""
    rows = [(c, 0, b) for c in range(8) for b in range(1, 6)]
    links = spark.createDataFrame(rows, "cluster long, a long, b long")
    groups = spark.createDataFrame([(u, 0, 0) for u in range(6)], "uid long, f0 long, f1 long")
    parts = spark.createDataFrame([(0, 0), (1, 0)], "uid long, component long")
    word = lambda *x: np.array(x, np.uint32).tobytes()
    sets = spark.createDataFrame([(u, bytearray(word(1, 2, 3) if u < 3 else word(9) if u < 5 else word(7, 8))) for u in range(6)], "uid long, hashes binary")
    made, join = [], type(links).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "uid":
            made.append(out.count())
        return out

    monkeypatch.setattr(type(links), "join", counted)
    found = {frozenset((r.a, r.b)) for r in simhash._edges_between(links, groups, parts, sets, 0.8).collect()}
    assert made and max(made) <= 6
    assert frozenset((3, 4)) in found and {frozenset((0, 2)), frozenset((1, 2))} & found
    assert not any(5 in e for e in found)


@pytest.mark.parametrize("text", ["", " ", "a", "word, Word. 'tis don't 12ab ab12 x_y {\"k\": 3}!", "tab\there new\nline", "naïve café. ÀÉ! 3½", "\x00 \x7f 漢字 ok", "x" * 200 + " y", "' '' '.' .a a. a.b .", "end "])
def test_chunks_as_the_library_has_them(text):
    enc = ByteLevelEncoder(vocabulary("byte_bpe_50k.json"), "<u2")
    ids, n = enc.encode([text, "some other " + text])
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in (text, "some other " + text)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
