"""Walks back through made histories against plain ones, step by step."""

import difflib
import hashlib
import random
from collections import defaultdict

from stratadiff.operators import diffs
from stratadiff.plans import walks

COMMITS, FILES = 6, ("f", "g")


class History:
    """Two files over a few commits; lines are (identity, text), and a line that moves to the other file has a new identity."""

    def __init__(self, seed):
        r = self.r = random.Random(seed)
        self.ids, self.born = iter(range(10**6)), {}
        now = {p: [self.line(0) for _ in range(r.randrange(8, 14))] for p in FILES}
        self.versions = [now]
        for c in range(1, COMMITS):
            now = {p: list(v) for p, v in now.items()}
            gone = []
            for p in FILES:
                for _ in range(r.randrange(1, 3)):
                    at, out = r.randrange(len(now[p])), r.randrange(3)
                    gone += now[p][at : at + out]
                    text = r.choice(gone)[1] if gone and r.random() < 0.5 else None
                    now[p][at : at + out] = [self.line(c, text if i == 0 else None) for i in range(r.randrange(1, 3))]
                if r.random() < 0.3:
                    now[p].append(self.line(c))
            self.versions.append(now)
        self.meant = {}
        for c in range(1, COMMITS):
            for p in FILES:
                old = self.texts(c - 1, p)
                for j in self.opcodes(c - 1, c, p)[1]:
                    if r.random() < 0.4:
                        self.meant[c, p, j] = " " + r.choice(old)

    def line(self, c, text=None):
        i = next(self.ids)
        self.born[i] = c
        return i, text or hashlib.md5(f"{i} {c} {self.r.random()}".encode()).hexdigest()

    def texts(self, c, p):
        return [t for _, t in self.versions[c][p]]

    def opcodes(self, a, b, p):
        """The removed old lines, the added new ones with their place and next kept line, and old lines that stay with their new ones."""
        removed, added, kept = [], {}, {}
        ops = difflib.SequenceMatcher(None, self.texts(a, p), self.texts(b, p)).get_opcodes()
        for k, (tag, i1, i2, j1, j2) in enumerate(ops):
            if tag == "equal":
                kept.update({i1 + x + 1: j1 + x + 1 for x in range(i2 - i1)})
            else:
                removed += range(i1 + 1, i2 + 1)
                after = ops[k + 1][1] + 1 if k + 1 < len(ops) else None
                added.update({j: (i2 + 1, after) for j in range(j1 + 1, j2 + 1)})
        return removed, added, kept

    def blame(self, c, p, line):
        return self.born[self.versions[c][p][line - 1][0]]

    def halves(self, c, p):
        n = len(self.versions[c][p])
        return {"one": (1, n // 2), "two": (n // 2 + 1, n)}


def alike(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def walked(h, path, lines, kind, older):
    """What a walk tells, as {(path, commit, line, kind, depth)}."""
    c, depth, out = COMMITS - 1, 0, set()
    while lines:
        if -1 in lines:
            return out | {(path, c, x, kind, depth) for x in lines}
        origin = max(h.blame(c, path, x) for x in lines)
        if origin == c:
            return out
        kept = h.opcodes(c, origin, path)[2]
        lines, c = {kept[x] for x in lines if x in kept}, origin
        out |= {(path, c, x, kind, depth) for x in lines}
        if c == 0 or c in older:
            return out
        old, (removed, added, stays) = h.texts(c - 1, path), h.opcodes(c - 1, c, path)
        hit = {x for x in lines if x in added}
        here = {v: k for k, v in stays.items()}
        rest = {here[x] for x in lines - hit}
        found, other = set(), [p for p in FILES if p != path][0]
        for x in hit:
            if (c, path, x) in h.meant:
                name = next(k for k, (a, b) in h.halves(c, path).items() if a <= x <= b)
                a, b = h.halves(c - 1, path)[name]
                if not any(a <= y <= b for y in removed):
                    a, b = 1, len(old)
                found |= {i for i in range(a, b + 1) if alike(h.meant[c, path, x].replace(" ", ""), old[i - 1]) > 0.95}
        if not found:
            gone, before = h.opcodes(c - 1, c, other)[0], h.texts(c - 1, other)
            moved = {i for i in gone for x in hit if alike(h.texts(c, path)[x - 1], before[i - 1]) >= 0.9}
            if moved:
                path, found, rest = other, moved, set()
            elif hit:
                place, after = added[max(hit)]
                if kind == "add":
                    found = {-1 if place > len(old) else place}
                elif after is None:
                    return out
                else:
                    found, kind = {after}, "add"
        lines, c, depth = found | rest, c - 1, depth + 1
    return out


def tables(spark, made):
    key = "repo string, path string, commit_id string"
    rows = defaultdict(list)
    for repo, h in made.items():
        for c in range(COMMITS):
            rows["rank"].append((repo, f"c{c}", c))
            rows["edges"].append((repo, f"c{c}", f"c{c - 1}" if c else None, 0))
            for p in FILES:
                rows["blame"] += [(repo, p, f"c{c}", x, f"c{h.blame(c, p, x)}") for x in range(1, len(h.versions[c][p]) + 1)]
                patch = lambda a, b: "\n".join(difflib.unified_diff(h.texts(a, p), h.texts(b, p), "a/x", "b/x", lineterm=""))  # noqa: B023, E731
                rows["between"] += [(f"{repo}:{p}:c{c}:c{o}", patch(c, o)) for o in range(c)]
                if c:
                    rows["changes"].append((f"{repo}:{p}:c{c}", patch(c - 1, c)))
                    rows["before"] += [(repo, p, f"c{c}", i, t) for i, t in enumerate(h.texts(c - 1, p), 1)]
                    rows["functions"] += [(repo, p, f"c{c}", old, n, a, b) for old in (True, False) for n, (a, b) in h.halves(c - old, p).items()]
                    rows["elsewhere"] += [(repo, p, f"c{c}", i, h.texts(c - 1, p)[i - 1]) for i in h.opcodes(c - 1, c, p)[0]]
        rows["meant"] += [(repo, p, f"c{c}", x, v) for (c, p, x), v in h.meant.items()]
    frame = lambda name, schema: spark.createDataFrame(rows[name], schema)

    def parsed(name, *columns):
        lines = diffs.diff_lines(frame(name, "id string, text string"), "id").drop("path")
        return lines.selectExpr(*(f"split(id, ':')[{i}] AS {c}" for i, c in enumerate(columns)), "*").drop("id")

    return {
        "blame": frame("blame", f"{key}, line_no int, origin_commit string"), "rank": frame("rank", "repo string, commit_id string, rank int"),
        "between": parsed("between", "repo", "path", "commit_id", "origin_commit"), "changes": parsed("changes", "repo", "path", "commit_id"),
        "edges": frame("edges", "repo string, commit_id string, parent_id string, parent_idx int"), "before": frame("before", f"{key}, line_no int, value string"),
        "functions": frame("functions", f"{key}, old boolean, name string, start_line int, end_line int"),
        "elsewhere": frame("elsewhere", f"{key}, line_no int, value string"), "meant": frame("meant", f"{key}, line_no int, value string"),
    }


def test_walks_of_random_histories(spark):
    made = {f"r{i}": History(i) for i in range(6)}
    r, starts = random.Random(1), {}
    for repo, h in made.items():
        for w in range(25):
            p = r.choice(FILES)
            n = len(h.versions[-1][p])
            starts[repo, w] = (p, set(r.sample(range(1, n + 1), r.randint(1, 3))), r.choice(["add", "remove"]))
    t = tables(spark, made)
    known = walks.places(t["changes"], t["meant"], t["before"], t["functions"], t["elsewhere"], ["repo"])
    rows = [(repo, w, p, f"c{COMMITS - 1}", x, kind) for (repo, w), (p, lines, kind) in starts.items() for x in lines]
    start = spark.createDataFrame(rows, "repo string, walk int, path string, commit_id string, line_no int, kind string")
    older = spark.createDataFrame([(repo, f"c{c}") for repo in ("r0", "r1") for c in (0, 1, 2)], "repo string, commit_id string")
    got = walks.walked_chunks(start, t["blame"], t["rank"], t["between"], t["changes"], known, t["before"], t["edges"], ["repo"], older)
    found = defaultdict(set)
    for x in got.collect():
        found[x.repo, x.walk].add((x.path, int(x.commit_id[1:]), x.line_no, x.kind, x.depth))
    want = {k: walked(made[k[0]], p, lines, kind, {0, 1, 2} if k[0] in ("r0", "r1") else set()) for k, (p, lines, kind) in starts.items()}
    assert {k: v for k, v in want.items() if v} == dict(found)
    told = [x for v in want.values() for x in v]
    assert max(x[4] for x in told) >= 2 and any(x[2] == -1 for x in told)
    assert any(p != starts[k][0] for k, v in want.items() for p, *_ in v)
