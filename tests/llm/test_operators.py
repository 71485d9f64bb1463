"""Each operator against plain Python, with nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import io
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

AWKWARD = [None, "", " ", "\n\n", "one", "a b c d", "The of and to in. " * 3000, "é💡 x\ty\r\nz  end ", "<|endoftext|> it's DON'T", "word" * 3000, "1,2;3 ½ Ⅷ", "a  b", " lead", "trail ", "tab\t\tx"]


def frame(spark, texts, first=0, **more):
    rows = [(first + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def words(text):
    return [w for w in "".join(" " if c in WS else c for c in (text or "")).split(" ") if w]


# tokens, token files


@pytest.mark.parametrize("kind, name", [("ByteEncoder", "byte_bpe_50k.json"), ("WordEncoder", "word_bpe_49k.json")])
def test_ids_are_the_librarys(kind, name):
    import public_tokenizers

    from slopeworks.llm import tokens

    e = getattr(tokens, kind)(public_tokenizers.path(name))
    from tokenizers import Tokenizer

    texts = [*AWKWARD, "hello <|endoftext|> world", "x<|startoftext|>y", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> a"]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(e.encode(texts)) == want
    assert list(e.encode(texts)) == want  # now from what is known


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from slopeworks.llm.token_files import Reader, read_token_files, write_token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = frame(spark, [*AWKWARD, "one"], start="x", file=1)
    manifest = write_token_files(docs.repartition(3), f"file://{tmp_path}/t", path, files=4)
    got = {r["doc_id"]: r for r in read_token_files(manifest).collect()}
    start = 0
    for k, text in enumerate([*AWKWARD, "one"]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert read_token_files(write_token_files(docs.limit(0), f"file://{tmp_path}/e", path)).count() == 0
    some = manifest.orderBy(F.desc("docs")).first()["file"].removeprefix("file://")
    reader = Reader(open(some, "rb"))
    last = int(reader.doc_ids[-1])
    assert [i for i, _ in reader.fetch([last])] == [last]


def test_token_files_hold_documents_without_an_id(spark):
    import public_tokenizers

    from slopeworks.llm.token_files import token_files

    docs = spark.createDataFrame([(2, "two"), (None, "none"), (1, None), (None, "")], "doc_id long, text string")
    got = sorted(token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 2] and got[2]["n_tokens"] == 1


def test_reader_takes_only_the_frames_asked_for_and_checks_them():
    from slopeworks.llm.token_files import Reader, Writer

    sink = io.BytesIO()
    w = Writer(sink, frame_bytes=64)
    docs = [(i, np.arange(i % 7 + 1, dtype="<u4").tobytes()) for i in range(100)] + [(100, b"")]
    for d in docs:
        w.add(*d)
    w.close()
    reader = Reader(io.BytesIO(sink.getvalue()))
    assert list(reader.documents()) == docs
    seen = []
    real = reader.frame
    reader.frame = lambda k: seen.append(k) or real(k)
    assert list(reader.fetch([5, 50])) == [docs[5], docs[50]] and len(seen) == 2 < len(reader.frames)
    spoilt = bytearray(sink.getvalue())
    at = len(spoilt) - 9 - 12 * len(reader.frames) + 8
    spoilt[at] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(Reader(io.BytesIO(bytes(spoilt))).documents())


# packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    from slopeworks.llm.packing import plan_packing

    r = np.random.default_rng(seed)
    lengths = np.clip(np.exp(r.normal(6, 1.3, [1, 7, 300, 5000, 40000, 0][seed])).astype(int), 1, 4096)
    histogram = dict(Counter(lengths.tolist()))
    plan = plan_packing(histogram)
    got = Counter()
    for copies, contents in plan:
        assert copies > 0 and sum(n * c for n, c in contents) <= 4096
        for n, c in contents:
            got[n] += c * copies
    assert got == Counter(histogram)
    sequences = sum(c for c, _ in plan)
    assert sequences <= -(-int(lengths.sum()) // 4096) * 1.05 + 3


def test_packed_documents(spark):
    import public_tokenizers

    from slopeworks.llm.packing import pack_documents
    from slopeworks.llm.tokens import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame(spark, AWKWARD, length="clash", row=3).unionByName(frame(spark, ["one"], first=4, length="clash", row=3))
    rows = pack_documents(docs, path).collect()
    ids = [i + b"\1\0\0\0" for i in WordEncoder(path).encode([*AWKWARD, "one"])]
    assert len(rows) == sum(-(-len(i) // (4 * 4096)) for i in ids)
    for r in rows:
        own = ids[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]
        assert r["start"] == 4096 * r["piece"] and r["ids_crc32"] == zlib.crc32(own) and r["length"] == len(own) // 4
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack_documents(docs.limit(0), path).count() == 0


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_permutation(spark, n):
    from slopeworks.llm.sharding import feistel

    got = [r[0] for r in spark.range(n).select(feistel(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or got != list(range(n))


def test_shards(spark, tmp_path):
    from slopeworks.llm.sharding import row_of, shard_rows

    frame(spark, AWKWARD * 20, slot="clash", _file="clash").repartition(5).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    rows = shard_rows(table).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(rows) == 300
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, shard_rows(table).collect()))
    assert row_of(3, 2, 300) == 35 and row_of(15, 18, 300) == -1
    table.limit(0).write.parquet(f"{tmp_path}/e")
    assert shard_rows(spark.read.parquet(f"{tmp_path}/e")).count() == 0


# quality


def test_quality_measures(spark):
    from slopeworks.llm.quality import judge

    texts = [*AWKWARD, "a b c a b c x", "x y z\nx y z\n\nw", "the cat and the dog of " * 20, " ".join(f"w{i}" for i in range(200)), "#*$ %& |<> word"]
    docs = frame(spark, texts, n_words="clash", kept="clash").unionByName(frame(spark, texts[-2:], first=len(texts) - 2, n_words="clash", kept="clash"))
    for r in judge(docs).collect():
        text = texts[r["doc_id"]] or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    judged = judge(docs)
    assert judged.filter("kept").count() + judged.filter("NOT kept").count() == docs.count()
    assert judge(docs.limit(0)).count() == 0


# lines


def test_shared_lines_go(spark):
    from slopeworks.llm.lines import drop_shared_lines

    rows = [(i, f"top {i}\n  Cookies here \nmid\n\nend {i % 3}", f"s{i}", 0) for i in range(12)]
    rows += [(20, None, "s1", 0), (21, "", None, 0), (22, "Cookies here", None, 0), (23, "mid\nmid\nx", "s3", 0), (23, "mid\nmid\nx", "s3", 0), (None, "mid\ny", "s4", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines_removed int")
    got = {r["doc_id"]: r for r in drop_shared_lines(docs, 4).collect()}
    assert drop_shared_lines(docs, 4).count() == len(rows)
    assert got[0]["text"] == rows[0][1] and got[0]["lines_removed"] == 0  # the first keeps them
    assert got[5]["text"] == "top 5\n" and got[5]["lines_removed"] == 3
    assert got[22]["text"] == "" and got[20]["text"] is None and got[21]["text"] == "" and got[23]["text"] == "x" and got[None]["text"] == "y"
    # end 0, 1 and 2 stand on exactly four sites: near the threshold, counted exactly
    assert got[3]["text"] == "top 3\n" and got[4]["lines_removed"] == 3
    assert drop_shared_lines(docs, 5).filter("doc_id = 3").first()["text"] == "top 3\n\nend 0"
    assert drop_shared_lines(docs.limit(0)).count() == 0


# Jaccard join


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("frequent", [50, 3])
def test_components_of_alike_documents(spark, monkeypatch, frequent):
    import random

    from slopeworks.llm import jaccard

    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rnd = random.Random(frequent)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    texts = list(AWKWARD)
    for _ in range(70):  # copies with edits, so that many pairs lie on either side of the limit
        copy = list(base)
        for _ in range(rnd.randrange(7)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(1000)}"
        texts.append(" ".join(copy))
    texts += [texts[-1].upper(), texts[-1], "A b C d", "a B c D", " ".join(base[:60])]
    texts += [" ".join(f"u{rnd.randrange(900)}" for _ in range(rnd.randrange(3, 90))) + " and so on it goes like this always" for _ in range(60)]
    docs = frame(spark, texts, n=1, id="x", component_id=5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.shingle_components(docs).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert len(set(v for _, v in got.values())) < len(texts) - 20


def test_components_of_odd_tables(spark):
    from slopeworks.llm.jaccard import shingle_components

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, None)]
    got = shingle_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert shingle_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_connected_components(spark):
    from slopeworks.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


@pytest.mark.parametrize("links_a_task", [20, 60])
def test_components_across_tasks(spark, links_a_task):
    import random

    from slopeworks.llm.components import connected_components

    rnd = random.Random(links_a_task)
    edges = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)] + [(500, k) for k in range(400, 500)] + [(k, k + 1) for k in range(600, 640)] + [(9, None), (None, 9)]
    want = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), links_a_task).collect()
    assert sorted(got) == sorted(want) and len(dict(want)) == len(want)
    root = dict(want)
    assert all(root[a] == root[b] <= min(a, b) for a, b in edges if None not in (a, b))


def test_rows_of_one_doc_id_are_linked_by_their_texts(spark):
    from slopeworks.llm.jaccard import drop_near_copies, shingle_components

    a, b, c = ("the quick brown fox jumps over the lazy dog and runs away", "one two three four five six seven eight", "lorem ipsum dolor sit amet consectetur")
    rows = [(1, a, "k"), (1, b, "k"), (2, c, "k"), (3, a, "k"), (4, b.upper(), "k"), (None, c, "k"), (None, None, "k"), (5, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in shingle_components(docs).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (1, 4, 1), (1, 8, 1), (2, 2, 2), (3, 8, 1), (4, 4, 1), (5, 0, 5)]
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (1, b), (1, a), (2, c), (5, "")]
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_the_join_takes_few_jobs(spark):
    """Every job keeps plans and task states on the driver, so their number is part of what the operator costs."""
    import random

    from slopeworks.llm.jaccard import shingle_components

    rnd = random.Random(4)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    near = []
    for _ in range(500):
        copy = list(base)
        for _ in range(rnd.randrange(9)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(1000)}"
        near.append(" ".join(copy))
    texts = ["same words in all of these many documents here"] * 400 + near + [" ".join(f"u{rnd.randrange(9000)}" for _ in range(60)) for _ in range(500)]
    sc = spark.sparkContext
    sc.setJobGroup("jobs of the join", "")
    try:
        found = shingle_components(frame(spark, texts)).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("jobs of the join"))
    assert len(found) == 1400 and jobs <= 120, jobs


# decontamination


def test_lines_of_blanks_alone_stay(spark):
    from slopeworks.llm.lines import drop_shared_lines

    docs = spark.createDataFrame([(k, f"a{k}\n\t\n\r\n \x0b\nshared line\r\nz", f"s{k}") for k in range(12)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in drop_shared_lines(docs).collect()}
    assert got[3]["text"] == "a3\n\t\n\r\n \x0b" and got[3]["lines_removed"] == 2 and got[0]["lines_removed"] == 0


def test_leaks(spark):
    import random

    from slopeworks.llm.decontaminate import drop_leaks, find_leaks, left_out

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(30)), " ".join(word() for _ in range(6)), "too short", None, ""]
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = items[0].split()
    for k in (3, 12, 19, 27):
        edited[k] = word()
    half = " ".join(items[0].split()[:18])
    scattered = " ".join(w if k % 3 else word() for k, w in enumerate(items[0].split()))
    texts = [filler(50) + " " + items[0].upper() + ". " + filler(9), filler(20) + " " + " ".join(edited), half, scattered, items[1] + "!", "too short", filler(200), *AWKWARD]
    docs = frame(spark, texts, item_id="clash", key=1, around="x", _doc=7).unionByName(frame(spark, texts[:1], item_id="clash", key=1, around="x", _doc=7))
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)] + [(0, items[0], 1)], "item_id long, text string, doc_id int")
    got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (4, 1)]
    assert sorted(r["doc_id"] for r in drop_leaks(docs, bench).collect()) == sorted(set(range(len(texts))) - {0, 1, 2, 4})
    assert sorted(r["item_id"] for r in left_out(bench).collect()) == [2, 3, 4]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def plain_leaks(docs, items):
    """(doc, item): the best count of words in place over all windows, by the rule alone."""
    out = {}
    for d, doc in docs.items():
        for i, item in items.items():
            size = min(len(item), 16)
            for off in range(-len(item), len(doc)):
                same = [int(0 <= off + k < len(doc) and doc[off + k] == w) for k, w in enumerate(item)]
                best = max(sum(same[k:k + 16]) for k in range(max(1, len(item) - 15)))
                if 100 * best >= 75 * size:
                    out[d, i] = max(out.get((d, i), (0, 0)), (best, size))
    return out


def test_seeds_hit_every_window_of_the_rule():
    from itertools import combinations

    from slopeworks.llm.decontaminate import BEFORE, SEEDS, WINDOW

    for size in range(5, WINDOW + 1):
        seeds = SEEDS[max(n for n in SEEDS if n <= size)]
        assert all(m[:2] == "11" and m[-1] == "1" and WINDOW - len(m) <= BEFORE for m in seeds)
        kept = [{at + k for k, c in enumerate(m) if c == "1"} for m in seeds for at in range(size - len(m) + 1)]
        for replaced in combinations(range(size), size * 25 // 100):
            assert any(not k & set(replaced) for k in kept), (size, replaced)


def test_leaks_equal_a_plain_scan(spark):
    import random

    from slopeworks.llm.decontaminate import find_leaks

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = {k: [word() for _ in range(n)] for k, n in enumerate((60, 40, 24, 16, 15, 14, 13, 12, 10, 9, 8, 7, 6, 5))}
    docs = {}
    for i, item in items.items():
        for every in (3, 4, 5, 8):
            docs[len(docs)] = [word() if k % every == every - 1 else w for k, w in enumerate(item)]
        docs[len(docs)] = [word() if k % 8 > 5 else w for k, w in enumerate(item)]  # runs of six
        for _ in range(12):
            size = min(len(item), 16)
            at = rnd.randrange(len(item) - size + 1)
            wrong = set(rnd.sample(range(size), size * 25 // 100 + rnd.choice((0, 0, 0, 1))))
            docs[len(docs)] = [word() for _ in range(rnd.randrange(20))] + [word() if k in wrong else w for k, w in enumerate(item[at:at + size])] + [word() for _ in range(rnd.randrange(20))]
        docs[len(docs)] = item[:-(-3 * min(len(item), 16) // 4)]  # cut off where the document ends
    want = plain_leaks(docs, items)
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(4)
    bench = lambda some: spark.createDataFrame([(i, " ".join(w)) for i, w in some.items()], "item_id long, text string")
    found = lambda some: {(r["doc_id"], r["item_id"]): (r["matched"], r["of"]) for r in find_leaks(table, bench(some)).collect()}
    assert found(items) == want and len(want) > 150
    # Unrelated items change nothing.
    long = {i: w for i, w in items.items() if len(w) >= 16}
    assert found(long) == {k: v for k, v in want.items() if k[1] in long}


# language


def test_language_on_held_out_documents(spark):
    from slopeworks.llm.language import fit_languages, held_out, predict_language

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = fit_languages(docs)
    got = predict_language(docs.withColumn("held_out", held_out()), network).filter("held_out AND n_chars > 40").select("lang", "lang_pred", "score").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = {r["doc_id"]: r for r in predict_language(frame(spark, AWKWARD, lang_pred="xx", score="y"), network).collect()}
    assert [odd[k]["lang_pred"] for k in range(4)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in odd.values())
    assert predict_language(docs.limit(0), network).count() == 0
    assert {r["lang_pred"] for r in predict_language(frame(spark, ["text"]), fit_languages(docs.limit(0))).collect()} == {"und"}


def test_gradients_of_the_networks():
    from slopeworks.llm.html_text import BlockNetwork, blocks, features
    from slopeworks.llm.language import ByteNetwork

    def check(net, loss):
        net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
        grads = loss()[1]
        for name, g in grads.items():
            at = np.unravel_index(np.abs(g).argmax(), g.shape)
            kept = net.weights[name][at]
            net.weights[name][at] = kept + 1e-4
            up = loss()[0]
            net.weights[name][at] = kept - 1e-4
            down = loss()[0]
            net.weights[name][at] = kept
            assert abs((up - down) / 2e-4 - g[at]) < 1e-3 * max(1e-3, abs(g[at])), name

    codes = np.random.default_rng(0).integers(0, 255, (5, 4)).astype(np.uint8)
    net = ByteNetwork(["a", "b"])
    check(net, lambda: net.gradients(codes, np.array([0, 1, 1, 0]), np.ones((5, 4), np.float32)))
    pages = [features(blocks(h)) for h in ("<p>one two<p>three</p><div class=ad>x y z</div>", "<h1>t</h1><p>four five.")]
    total = sum(map(len, pages))
    page_net = BlockNetwork()
    check(page_net, lambda: page_net.gradients(pages, np.arange(total) % 2 * 1.0, np.ones(total)))


# pages


def test_main_text_of_the_given_pages(spark):
    import html
    import re

    from slopeworks.llm.html_text import extract_text, fit_blocks

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    network = fit_blocks(pages)
    odd = spark.createDataFrame([(900, "u", None), (901, "u", ""), (902, "u", "<p>"), (903, "u", "<div class='x" + "<p>a b" * 3000), (904, "u", "a < b &lt;c&gt; &amp")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract_text(pages.unionByName(odd).withColumn("text", F.lit("clash")), network).collect()}
    wrong = 0
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        wrong += got[r["page_id"]]["text"] != "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert wrong <= 1
    assert got[900]["text"] == got[901]["text"] == got[902]["text"] == ""
    assert extract_text(pages.limit(0), network).count() == 0


P, Q = "The committee met on Tuesday to discuss the new water plan for the valley and its people.", "After two hours of talks, no decision was made, and members agreed to meet again next week."
NAV, FOOT = "<nav><ul><li><a href=#>Home</a></li><li><a href=#>News</a></li></ul></nav>", "<footer><p>Copyright 2020 All rights reserved</p></footer>"
HAND_MADE = {
    "list": (f"{NAV}<article><h1>Water plan</h1><p>{P}</p><ul><li>First point of the plan</li><li>Second point of the plan</li></ul><p>{Q}</p></article>{FOOT}", ["Water plan", P, "First point of the plan", "Second point of the plan", Q]),
    "header": (f'{NAV}<article><header class="entry-header"><h1>Water plan</h1></header><p>{P}</p><p>{Q}</p></article>{FOOT}', ["Water plan", P, Q]),
    "misleading class": (f'{NAV}<main><h1>Water plan</h1><p class="share-price">{P}</p><p>{Q}</p></main>{FOOT}', ["Water plan", P, Q]),
    "layout table": (f"<table><tr><td><a href=#>Home</a></td></tr><tr><td><p>{P}</p><p>{Q}</p></td></tr></table>{FOOT}", [P, Q]),
    "data table": (f"{NAV}<article><h1>Water plan</h1><p>{P}</p><table><tr><td>River</td><td>120</td></tr><tr><td>Lake</td><td>80</td></tr></table><p>{Q}</p></article>{FOOT}", ["Water plan", P, "River", "120", "Lake", "80", Q]),
    "quote": (f"{NAV}<article><h1>Water plan</h1><p>{P}</p><blockquote><p>We will see, they said.</p></blockquote><p>{Q}</p></article>{FOOT}", ["Water plan", P, "We will see, they said.", Q]),
    "comments": (f'{NAV}<article><h1>Water plan</h1><p>{P}</p><p>{Q}</p></article><div class="comments"><div class="comment"><p>I think this is a great plan and we should all be glad.</p></div></div>{FOOT}', ["Water plan", P, Q]),
    "share buttons": (f'{NAV}<article><h1>Water plan</h1><p>{P}</p><div class="share-buttons"><a>Tweet</a> <a>Share</a></div><p>{Q}</p></article>{FOOT}', ["Water plan", P, Q]),
    "quoted >": (f'<article><p title="a > b">{P}</p><p>{Q}</p></article>', [P, Q]),
}


def test_main_text_of_hand_made_pages(spark):
    from slopeworks.llm.html_text import extract_text, fit_blocks

    network = fit_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    made = spark.createDataFrame([(k, "u", f"<body>{page}") for k, (page, _) in enumerate(HAND_MADE.values())], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_text(made, network).collect()}
    assert {name: got[k] for k, name in enumerate(HAND_MADE)} == {name: "\n".join(want) for name, (_, want) in HAND_MADE.items()}


@pytest.mark.parametrize("page, want", [
    ('<body onload="if(a>b)x()"><p title=\'<p>\'>Hello</p>', ["Hello"]), ("<p data-x=it's>a</p><p>b</p>", ["a", "b"]), ('<p title="a>b</p><p>c</p>', ["b", "c"]),
    ('<img alt="1 > 0"><p>d</p>', ["d"]), ("<svg viewBox='>' ><path/></svg><p>e</p>", ["e"]), ("<p =" * 2000 + ">f", None), ('<p a="' * 500, None)])
def test_quoted_values_are_units(page, want):
    from slopeworks.llm.html_text import blocks

    got = [t for _, t, _ in blocks(page)]
    assert want is None or got == want


def test_names_that_tell():
    from slopeworks.llm.html_text import blocks, telling

    assert telling(("body", "article", "header", "entry-header", "h1")) in (1, None) and telling(("body", "header", "h1")) == 0
    assert telling(("body", "article", "p")) == 1 and telling(("body", "article", "aside", "p")) == 0 and telling(("body", "comments", "article", "p")) == 0
    assert telling(("main", "p", "share-price")) is None and telling(("div", "share-buttons")) == 0 and telling(("div", "p")) is None
    assert blocks('<div data-id="nav" title="class=ad"><p>x</p></div>')[0][0] == ("div", "p")


def test_sample_of_pages_is_bounded_and_told(spark):
    from slopeworks.llm.html_text import sample_pages

    told, bare = [(k, f"<article><p>{k}</p></article>") for k in range(3000)], [(k, f"<div>{k}</div>") for k in range(3000, 9000)]
    pages = spark.createDataFrame(told + bare + [(1, told[1][1])] * 500 + [(None, None)], "page_id long, html string")
    got = sample_pages(pages, 40)
    assert len(got) == len(set(got)) == 40 and all("article" in h for h in got)
    assert len(sample_pages(pages.filter("html LIKE '<div>%'"), 40)) == 40 and sample_pages(pages.limit(0), 40) == []


def test_blocks():
    from slopeworks.llm.html_text import blocks

    page = "<html><head><title>no</title><style>x{}</style></head><body><nav><ul><li><a href=x>Home</a><li>Two</ul></nav><!-- <p>no --><p class='lead  big'>A &amp; <b>b</b><br>c\n d<p>e<script>var t='</p>';</script></body>"
    assert [(p, t) for p, t, _ in blocks(page)] == [
        (("html", "body", "nav", "ul", "li"), "Home"), (("html", "body", "nav", "ul", "li"), "Two"), (("html", "body", "p", "lead", "big"), "A & b c d"), (("html", "body", "p"), "e")]


@pytest.mark.parametrize("inner", [
    "<svg-icon name=x></svg-icon>", "<select-box></select-box>", "<title-bar></title-bar>", "<template-x>", "<iframe-lazy src=x></iframe-lazy>", "<svg class=i/>", "<svg/>", '<svg class="i" />',
    "<SVG viewBox='0 0 1 1'/>", "<svg><path d=x/></svg>", "<svg><path d=x/></svg x>", "<script>var a='<p>no</p>'</script >", "<select><option>no</select>", "<title>no</title\n>"])
def test_only_raw_elements_hide_what_follows(inner):
    from slopeworks.llm.html_text import blocks

    page = f"<article><p>One.</p>{inner}<p>Two.</p><p>Three <b>x</b>.</p></article>"
    assert [t for _, t, _ in blocks(page)] == ["One.", "Two.", "Three x."]


def test_text_inside_custom_elements_stays():
    from slopeworks.llm.html_text import blocks

    assert [t for _, t, _ in blocks("<p>a <svg-icon>b</svg-icon> c <title-bar>d</title-bar></p><template-x><p>e</p></template-x><svg/><svg>no</svg><p>f")] == ["a b c d", "e", "f"]


# registered queries and the pipeline


def test_queries_agree_with_their_sql(spark):
    import duckdb

    from check import TABLES, compare
    from slopeworks.llm.queries import ORACLES, QUERIES

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        rel = duck.sql(sql)
        columns = rel.columns
        assert compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), columns) == "", name
    assert len({n.split("_")[0] for n in QUERIES}) == 13


def test_only_letters_have_a_language(spark):
    from slopeworks.llm.language import has_letter

    assert [has_letter(t) for t in (None, "", "10 ½", "²①Ⅷ", "12 _ 3", "½ a", "日本", "ʰ")] == [False] * 5 + [True] * 3


def test_rare_labels_are_left_out(spark, monkeypatch):
    from slopeworks.llm import language

    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(k, "the cat sat on the mat " * 5, "en") for k in range(40)] + [(100 + k, "der Hund lief über die Straße " * 5, "de") for k in range(40)] + [(200 + k, f"word {k}", f"x{k}") for k in range(10)]
    network = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)
    assert network.classes == ["de", "en"] and network.left_out >= 5


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    given = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = "the cat sat on the mat and looked at the dog for a very long time", "a quite different text about the weather in the north of the country today"
    odd = spark.createDataFrame([(1, a, "en", "s", 0), (1, b, "en", None, 0), (None, a.upper(), "en", "s", 0), (2, None, None, "s", 0), (None, "", "en", "s", 0), (3, "10 ½", "en", "s", 0)], given.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, docs, items in (("odd", odd, bench), ("none", odd.limit(0), bench), ("bare", odd, bench.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = [r["doc_id"] for r in cp.run(spark, f"{tmp_path}/{name}").collect()]
        assert got == [] if name == "none" else sorted(got, key=repr) == [1, 1], (name, got)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", None, "s", 7), (9003, "", "en", None, 0)], docs.schema)
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    known = steps["language_id"](spark, docs.unionByName(extra), SF).persist()
    assert known.columns == docs.columns
    left = {r["doc_id"] for r in known.collect()}
    assert not left & {9001, 9002, 9003} and len(left) >= docs.count() - 2
    freed = steps["line_dedup"](spark, known, SF).persist()
    rows = {r["doc_id"]: r for r in freed.collect()}
    assert freed.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    kept = {r["doc_id"] for r in steps["near_duplicates"](spark, freed, SF).collect()}
    assert kept == {v for _, v in brute_components([(i, r["text"]) for i, r in rows.items()]).values()}
    after = steps["decontamination"](spark, freed, SF)
    assert after.columns == docs.columns
    leaks = {r["doc_id"] for r in freed.join(after, "doc_id", "left_anti").collect()}
    items = [" ".join(words(r["text"])).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, r in rows.items() if any(t in " ".join(words(r["text"])).lower() for t in items)}
    assert whole <= leaks
    assert cp.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
