"""Hot spots against programs that are written with known counts."""

import random

from millrace.operators.hotspots import braced, indented
import millrace.operators  # noqa: F401
from millrace.plans.registry import QUERIES


def braces(rng, name, out, level=0, deep=0):
    """A function with nested blocks; returns its (name, line, cyclomatic, cognitive) and those inside, in order."""
    line = "".join(out).count("\n") + 1
    own, inner = [1, 0], []
    head = [f"function {name}(a, b) {{", f"const {name} = async (a) => {{", f"{name}(a) {{"][rng.randrange(3)]
    out.append(head + "\n")

    def block(depth, left):
        for _ in range(rng.randint(0, 3)):
            kind = rng.random()
            if kind < 0.4 and left:
                joins = rng.randint(0, 2)
                out.append("if (a" + " && b" * joins + ") { // if (x) {\n")
                own[0] += 1 + joins
                own[1] += depth + joins
                block(depth + 1, left - 1)
                out.append("}\n")
            elif kind < 0.6 and left:
                out.append("{\n")
                block(depth + 1, left - 1)
                out.append("}\n")
            elif kind < 0.7 and left and level < 2:
                inner.extend(braces(rng, f"{name}i{len(inner)}", out, level + 1))
            else:
                out.append('call("if (a) { for", `while ${x}`);\n')

    block(1, 3)
    out.append("}\n")
    return [(name, line, *own), *inner]


def test_braces():
    for seed in range(150):
        rng, out, want = random.Random(seed), [], []
        for k in range(rng.randint(1, 4)):
            want += braces(rng, f"f{k}", out)
            out.append("if (top) { }\n")
        assert braced("".join(out)) == sorted(want, key=lambda f: f[1]), seed


def test_indents():
    text = "import os\nif x:\n    pass\ndef one(a):\n    if a and b:\n        for c in d:\n            e = 1\n    # if no\n    return 'if'\n\nclass C:\n    async def two(self):\n        def inner():\n            while True:\n                pass\n        if a or b:\n            pass\n"
    assert indented(text) == [("one", 4, 4, 4), ("two", 12, 3, 2), ("inner", 13, 2, 1)]


def test_whole_corpus(spark, sf_dir):
    rows = QUERIES["complexity_hotspots"](spark, sf_dir).collect()
    assert ("app", "src/lib/quiet.ts", "load", 2, 1) in {(r["repo"], r["path"], r["function"], r["cyclomatic"], r["cognitive"]) for r in rows}
