"""The unit vectors of FIXTURES.md as rows."""

import re
from pathlib import Path

TEXT = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()


def _table(section):
    body = TEXT.split(f"## {section}.")[1].split("\n## ")[0]
    rows = [[c.strip() for c in line.strip("|").split(" | ")] for line in body.splitlines() if line.startswith("| ")]
    return [r for r in rows[1:] if not r[0].startswith("-")]


def _state(x):
    x = x.strip()
    m = re.fullmatch(r"a\((.+), (.+)\)", x)
    return f"<{m[1]}|{m[2]}>" if m else {"EPS": "eps"}.get(x, x)


def pushdown():
    """[(name, initial transitions, rules, asserted)] of the pushdown vectors."""
    out = []
    for name, init, rules, asserted in _table(2):
        s, l = init.strip("()").split(",")
        start = [(s, l, "ACC", 0)]
        if name.endswith("popEpsilonTest1"):
            start.append(("3", "eps", "2", 0))
        elif name.endswith("popEpsilonTest"):
            start.append(("0", "eps", "1", 0))
        parsed = []
        for r in rules.split("; "):
            kind, a, w = re.fullmatch(r"(\w+) (\S+)(?: /(\d+))?", r).groups()
            left, right = a.split("→")
            s1, l1 = left.split(".", 1)
            right, _, site = right.partition("·")
            s2, _, l2 = right.partition(".")
            parsed.append(({"n": "normal"}.get(kind, kind), s1, l1, s2, l2, site, int(w or 0)))
        exact = None
        if m := re.search(r"exact set \{ (.*) \}", asserted):
            exact = {tuple(map(_state, re.fullmatch(r"(a\(.*?\)|\w+), (\w+), (a\(.*?\)|\w+)", t.strip()).groups())) for t in m[1].split(";")}
        held = [(tuple(map(_state, m.groups()[:3])), m[4]) for m in re.finditer(r"t\((a\(.*?\)|\w+), (\w+), (a\(.*?\)|\w+)\)(?: = (\w+))?", asserted)]
        counts = [re.search(rf"#{k} = (\d+)", asserted) for k in ("transitions", "states")]
        out.append((name, start, parsed, exact, held, [int(c[1]) if c else None for c in counts]))
    return out


def synchronised():
    """[(name, seed, flows, reached, not reached)] of the two-stack vectors."""
    out = []
    arrow = re.compile(r"(\w+)\.(\w+) (?:([+\-!])(\w+)|call@(\w+)|(ret))?→ (\w+)\.(\w+)")
    for name, seed, flows, reached, missed in _table(3):
        rows = []
        for f in flows.split("; "):
            m = arrow.fullmatch(f.replace("ret→", "ret→").strip())
            stmt, val, op, sym, site, ret, to_stmt, to_val = m.groups()
            kind = {"+": "field_push", "-": "field_pop", "!": "exclude"}.get(op) or ("call_push" if site else "call_pop" if ret else "normal")
            rows.append((kind, stmt, val, sym or site or "", to_stmt, to_val))
        nodes = lambda x: [] if x == "–" else [tuple(n.split(".")) for n in x.split(", ")]
        out.append((name, tuple(seed.split(".")), rows, nodes(reached), nodes(missed)))
    return out
