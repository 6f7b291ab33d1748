import random

from pathweave.operators import canonical as c


def test_examples():
    e = [("x", "P1", "a"), ("a", "P2", "y")]
    assert c.graph_text(e, "x") == "x,P1,a,a,P2,y," and c.pattern_text(e, "x", "y")[0] == "1,P1,2,2,P2,3,@3"
    assert c.graph_text([], "x") == "" and c.pattern_text([], "x", "y")[0] == "@0"


def test_order_and_cycles_do_not_matter():
    e = [("x", "P1", "a"), ("x", "P1", "b"), ("a", "P3", "y"), ("b", "P2", "y"), ("y", "P4", "x"), ("b", "P2", "a")]
    r = random.Random(1)
    first = c.pattern_text(e, "x", "y")[0], c.graph_text(e, "x")
    for _ in range(20):
        r.shuffle(e)
        assert (c.pattern_text(e + e[:2], "x", "y")[0], c.graph_text(e, "x")) == first
    # other names, same shape: the tie of the two P1 is broken by what follows
    names = {"x": "q", "a": "zz", "b": "aa", "y": "m"}
    assert c.pattern_text([(names[s], p, names[o]) for s, p, o in e], "q", "m")[0] == first[0]
