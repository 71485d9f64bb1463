"""Order MinHash, the conversation trie and vector codes against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

WS = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(f"[{WS}]+", text or "") if w]


# Order MinHash


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_of(*values):
    """Spark's xxhash64: each value with the hash of those before it as seed; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8 if abs(v) > 2**31 or isinstance(v, Long) else 4, "little", signed=True), seed)
    return signed(seed)


class Long(int):
    pass


def plain_fingerprint(text):
    low = (1 << 27) - 1
    pieces = re.findall(f"[^{WS}]{{1,8}}", text or "")
    if not pieces:
        return [0] * 64
    get = lambda i: pieces[i] if i < len(pieces) else None
    kmers = [hash_of(get(i), get(i + 1), get(i + 2)) for i in range(max(len(pieces) - 2, 1))]
    seen, circle = Counter(), []
    for place, h in enumerate(kmers):
        high = h >> 27
        circle.append((hash_of(Long(high), seen[high]) & ~low) | place)
        seen[high] += 1
    circle.sort()
    out = []
    for j in range(64):
        start = -(2**63) + (j << 58)
        first = sum(x < start for x in circle)
        a, b = sorted(circle[(first + k) % len(circle)] & low for k in (0, 1))
        out.append(hash_of(Long(kmers[a]), Long(kmers[b])))
    return out


def plain_order(rows):
    by_hash = lambda r: hash_of(r[1] if r[1] is not None else "")
    return sorted(rows, key=lambda r: (r[0] is None, -r[0] if r[0] is not None else 0, by_hash(r)))


ROWS = [(5, "one two three four five six seven eight nine ten"), (3, None), (9, ""), (7, " \t\n "), (1, "a"), (2, "a b"), (4, "one two three four five six seven eight nine ten"),
        (8, "é💡x " * 50), (6, "word" * 500), (10, "the cat and the dog and the cat and the dog and the cat ran " * 40), (None, "x y z"), (None, "p q r s"), (2, "b c d e f"), (11, "a  b")]


@pytest.mark.parametrize("rows", [ROWS, ROWS + [ROWS[0]] * 3 + [(None, "x y z")], ROWS[:1], ROWS[:1] * 3, []])
def test_order_fingerprints(spark, rows):
    from pyspark.sql import functions as F

    from slopeworks.llm.order_minhash import order_fingerprints

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_range": F.lit(1), "pairs": F.lit("x"), "next_text": F.lit(2)})
    got = sorted(map(tuple, order_fingerprints(df).collect()), key=repr)
    ordered = plain_order(rows)
    want = []
    hexed = lambda f: "".join(f"{x & 0xffffffff:08x}" for x in f)
    near = lambda a, b: sum(x == y for x, y in zip(a, b)) / 64
    for k, (doc_id, text) in enumerate(ordered):
        text, then = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + then[:half]
        f, e, n = map(plain_fingerprint, (text, edited, then))
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(f), hexed(e), near(f, e), near(f, n)))
    assert got == sorted(want, key=repr)


def test_likeness_falls_with_edits_and_with_moved_text(spark):
    from pyspark.sql import functions as F

    from slopeworks.llm.order_minhash import fingerprint, likeness

    r = np.random.default_rng(1)
    base = [f"w{x}" for x in r.integers(0, 3000, 2000)]
    some = lambda share: " ".join(f"n{i}" if r.random() < share else w for i, w in enumerate(base))
    texts = [" ".join(base), some(0.005), some(0.05), some(0.3), " ".join(base[1000:] + base[:1000]), " ".join(f"z{i}" for i in range(2000))]
    df = spark.createDataFrame([(i, texts[0], t) for i, t in enumerate(texts)], "i int, a string, b string")
    near = [x["n"] for x in df.select("i", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("n")).orderBy("i").collect()]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] >= near[5] == 0
    assert near[4] < 0.8  # the same k-mers, but the halves changed places


# the conversation trie


def plain_trie(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(first, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(words(n[-1][1])) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(kind):
    r = np.random.default_rng(3)
    if kind == "empty":
        return []
    if kind == "one":
        return [(7, 0, "user", "hello there")]
    if kind == "awkward":
        return [(20, None, "user", "first  one"), (20, 0, None, None), (20, 0, None, "x"), (20, 3, "", "x"), (21, 1, "user", "a"), (25, 2, "u", "a b c"), (25, 2, "u", "a b c"), (None, 1, "u", "lost"),
                (-5, 0, "u", "first  one"), (-20, 0, "u", "below zero"), (-20, 1, "u", "again"), (40, 0, "é💡", "long " * 5000)]
    if kind == "same":
        return [(c, t, "u", f"turn {t}") for c in range(300) for t in range(4)]
    rows = []
    for c in range(400):
        for t in range(int(r.integers(1, 9))):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", " ".join(f"w{r.integers(0, 3)}" for _ in range(r.integers(0, 3)))))
    rows += [(1000 + c, t, "u", "many" if t < 3 else f"{c}") for c in range(300) for t in range(4)]
    return rows


@pytest.mark.parametrize("kind", ["empty", "one", "awkward", "same", "many"])
def test_conversation_trie(spark, kind):
    from pyspark.sql import functions as F

    from slopeworks.llm.trie import conversation_trie

    rows = conversations(kind)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"hashes": F.lit(1), "key": F.lit("k")})
    assert sorted(map(tuple, conversation_trie(df.repartition(5)).collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("ranges", [1, 2, 7, 60])
def test_forests_of_ranges_add_up(ranges):
    """Nodes of ranges, added up by their ids, are those of one range."""
    from slopeworks.llm.trie import Forest, common

    r = np.random.default_rng(ranges)
    keys = sorted({b"".join(bytes([int(x)]) * 16 for x in r.integers(0, 3, r.integers(0, 7))) for _ in range(300)})
    counts, words_of = r.integers(1, 5, len(keys)).tolist(), [list(range(1, 1 + len(k) // 16)) for k in keys]

    def summed(cuts):
        total = {}
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            before = common(keys[lo - 1], keys[lo]) if lo else -1
            after = common(keys[hi - 1], keys[hi]) if hi < len(keys) else -1
            for n in Forest(keys[lo:hi], counts[lo:hi], list(range(lo, hi)), words_of[lo:hi], [None] * (hi - lo), before, after).nodes:
                row = np.array([n[c] for c in ("n_convs", "n_children", "n_leaves", "spent", "owned")])
                assert n["open"] or n["id"] not in total
                first, sums = total.get(n["id"], (n["conv_id"], 0))
                total[n["id"]] = min(first, n["conv_id"]), sums + row
        return {k: (a, *b.tolist()) for k, (a, b) in total.items()}

    cuts = [0, *sorted(r.integers(0, len(keys), ranges - 1).tolist()), len(keys)]
    assert summed(cuts) == summed([0, len(keys)])


# vector codes


def plain_codes(rows):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(4, -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4)
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    firsts = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:256]
    part = width // 4
    cut = lambda v, p: v[p * part:(p + 1) * part]
    books = [[cut(v, p) for _, v, _ in firsts] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e))
    for _ in range(4):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                groups[p, near(v, p)].append(cut(v, p))
        for (p, e), vs in groups.items():
            books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, v, lab in kept:
        codes = [near(v, p) for p in range(4)]
        error = sum(dist(cut(v, p), books[p][c]) for p, c in enumerate(codes))
        by_label[lab] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, lab))
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=repr)


def vectors(kind):
    r = np.random.default_rng(5)
    row = lambda i, v, lab=0: (i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab)
    if kind == "empty":
        return []
    if kind == "unusable":
        return [row(1, None), row(2, [1, None, 2, 3]), row(3, [float("nan"), 0, 0, 0]), row(4, [float("inf"), 0, 0, 0])]
    if kind == "awkward":
        return [row(3, [0.5, -0.5, 0.25, -0.0001], None), row(None, [1, 2, 3, 4], None), row(3, [0.5, -0.5, 0.25, -0.0001], 1), row(2, [1, 2, 3]), row(1, []), row(9, [5000.5, -7000.25, 1, 2], 2), row(4, None, 1)]
    if kind == "ties":
        return [row(i, [(i % 7) / 1024, (i % 3) / 1024, 0, (i % 2) / 512, 0, 0, 0, 1], i % 4) for i in range(700)]
    centres = r.normal(size=(9, 8))
    return [row(i, centres[r.integers(0, 9)] + r.normal(size=8) * 0.02 if i % 3 else centres[0], int(r.integers(0, 5)) or None) for i in range(900)]


@pytest.mark.parametrize("kind", ["empty", "unusable", "awkward", "ties", "clusters"])
def test_vector_codes(spark, kind):
    from pyspark.sql import functions as F

    from slopeworks.llm.vector_codes import vector_codes

    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"of": F.lit(1), "code": F.lit("c")})
    assert sorted(map(tuple, vector_codes(df.repartition(3)).collect()), key=repr) == plain_codes(rows)


@pytest.mark.parametrize("seed", range(4))
def test_cover_trees_cover_and_spare_comparisons(seed):
    from slopeworks.llm.vector_codes import assign, cover_tree, distances, subtree_sums

    r = np.random.default_rng(seed)
    centres = r.integers(-2000, 2000, (8, 4))
    points = np.concatenate([c + r.integers(-3, 4, (120, 4)) for c in centres] + [np.tile(r.integers(-9, 9, 4), (200, 1))])
    r.shuffle(points)
    order, nodes, radius = cover_tree(points)
    assert sorted(order) == list(range(len(points)))
    placed = points[order]
    for (a, b, child, end, centre), far in zip(nodes.tolist(), radius):
        assert np.sqrt(((placed[a:b] - placed[centre]) ** 2).sum(1)).max() <= far + 1e-9
        if end:
            assert [n[0] for n in nodes[child:end].tolist()] + [b] == [a] + [n[1] for n in nodes[child:end].tolist()]
    for entries, most in ((points[r.choice(len(points), 20, replace=False)], len(points)), (np.concatenate([centres, r.integers(-2000, 2000, (12, 4))]), len(points) / 4)):
        found, compared = assign(placed, nodes, radius, entries)
        assert (found == distances(placed, entries).argmin(1)).all() and compared <= most
    counts, sums = subtree_sums(placed, found, 20)
    assert all((sums[e] == placed[found == e].sum(0)).all() and counts[e] == (found == e).sum() for e in range(20))
