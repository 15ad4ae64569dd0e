"""p1, p2, p4, p8, p9 and p10 against brute force, other libraries and round trips, and their edges."""

import base64
import datetime as D
import os
import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connect, same  # noqa: E402

from fleetweave.llm import automaton, consolidate, golden, linkage, packing, queries, splitting, sql, tokens  # noqa: E402

T0 = D.datetime(2025, 1, 1)
FOLDER = os.path.dirname(tokens.vocabulary())
A = automaton.word_table(tokens.vocabulary())


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(spark, con, small, name):
    same(spark, con, queries.queries()[name], sql.oracle_sql()[name], small)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_runs(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


# p8


def tiktoken_encoding(file):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{FOLDER}/{file}", "rb"))}
    return tiktoken.Encoding("t", pat_str=automaton.SPLIT, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aab  's\n\t日é²_-.1\x1c \r"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=60))
def test_ids_as_of_another_library(text):
    import numpy as np

    global _ENC
    try:
        enc = _ENC
    except NameError:
        enc = _ENC = tiktoken_encoding("byte_bpe_50k.tiktoken")
    assert np.frombuffer(A.encode(text), dtype=np.int32).tolist() == enc.encode_ordinary(text) == A.automaton.encode(text)
    assert A.automaton.decode(enc.encode_ordinary(text)) == text


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_rank_files(file):
    enc, mine = tiktoken_encoding(file), automaton.Automaton.load(f"{FOLDER}/{file}")
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice("aaabcehlostu  's\n日本éß.,0129") for _ in range(r.randrange(50)))
        assert mine.encode(t) == enc.encode_ordinary(t)


def test_arcs_are_right_encodings():
    """An arc leads from a token to another exactly if the two stand side by side in the encoding of their text."""
    enc = tiktoken_encoding("byte_bpe_50k.tiktoken")
    r = random.Random(3)
    ids = sorted(A.automaton.labels)
    label = A.automaton.labels
    at = {x: i for i, x in label.items()}
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(3000)]
    for w in r.sample(ids, 3000):  # tokens cut in two, and more of the same at either side
        t = label[w]
        for k in range(1, len(t)):
            if t[:k] in at and t[k:] in at:
                pairs += [(at[t[:k]], at[t[k:]]), (at[t[:k]], w), (w, at[t[k:]]), (w, w)]
    for a, b in pairs:
        assert A.automaton.arc(a, b) == (enc._core_bpe.encode_single_piece(label[a] + label[b]) == [a, b]), (label[a], label[b])
    again = automaton.Automaton.unpacked(A.automaton.packed())
    assert again.encode("Waiting for approval") == A.automaton.encode("Waiting for approval")


def test_special_strings_and_runs():
    enc = tiktoken_encoding("byte_bpe_50k.tiktoken")
    for t in ("<|endoftext|>", "a" * 5000, " " * 999, "ab" * 777, "日本語" * 500, "\n\n \t x", "don't we'll I'm"):
        assert A.automaton.encode(t) == enc.encode_ordinary(t)


def test_encode_column(spark):
    long = "The queue depth of lyo-ap454 is normal. " * 20_000
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a b"), (3, "a b"), (4, long)], "k long, text string").withColumn("ids", F.lit("clash"))
    rows = tokens.encode_column(df, "k").collect()
    got = {r.k: r.ids for r in rows}
    assert len(rows) == 5 and got[1] == [] and got[2] == [] and len(got[4]) > 100_000 and rows[0].ids is not None
    back = {r.k: r.text for r in tokens.decode_column(tokens.encode_column(df, "k"), "k").collect()}
    assert back == {1: "", 2: "", 3: "a b", 4: long}
    assert tokens.encode_column(df.limit(0), "k").count() == 0
    assert {r.k: r.n_tokens for r in tokens.count_column(df, "k").collect()}[3] == 2


# p9


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_patterns_use_everything_once(histogram):
    got: dict[int, int] = {}
    used = 0
    for box, times in packing.patterns(histogram, 40):
        assert sum(box) <= 40 and times > 0
        used += times
        for x in box:
            got[x] = got.get(x, 0) + times
    assert got == histogram
    need = sum(s * n for s, n in histogram.items())
    assert used <= max(1, 2 * need / 40 + 1)


def test_little_room_is_left():
    r = random.Random(2)
    h: dict[int, int] = {}
    for _ in range(20_000):
        s = min(2048, max(1, int(r.lognormvariate(5, 1))))
        h[s] = h.get(s, 0) + 1
    need = sum(s * n for s, n in h.items())
    used = sum(t for _, t in packing.patterns(h, 2048))
    assert used <= need / 2048 * 1.001 + 1


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)  # several salts
    sizes = [(i, n) for i, n in enumerate([10] * 150 + [3] * 40 + [7, 11, 25, 250, 0, 0, None] + [100])]
    df = spark.createDataFrame(sizes, "k long, n_tokens long").withColumn("piece_no", F.lit("x")).withColumn("container_id", F.lit(1)).select("k", "n_tokens", "piece_no", "container_id")
    rows = packing.pack(df, "k", capacity=100).collect()
    fill: dict[int, int] = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.piece_size
    assert max(fill.values()) <= 100 and len([f for f in fill.values() if f]) <= sum(n or 0 for _, n in sizes) // 100 + 2
    pieces = sorted((r.k, r.piece_no, r.piece_start, r.piece_size) for r in rows)
    assert len(pieces) == len(set(p[:2] for p in pieces)) == len(sizes) + 2
    assert [p[1:] for p in pieces if p[0] == 193] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert {r.k for r in rows if r.piece_size == 0} == {194, 195, 196} and all(r.container_id is not None for r in rows)
    assert packing.pack(df.limit(0), "k", capacity=100).count() == 0
    assert packing.pack(df.where("n_tokens is null"), "k", capacity=100).first().container_id == 0


# p10


def pieces_of(spark, *texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    out: dict[int, list] = {}
    for r in splitting.split_texts(df, "k", **kw).orderBy("k", "piece_no").collect():
        out.setdefault(r.k, []).append(r)
    return out


def test_pieces(spark):
    para = "Waiting for approval by Sorrel. The cable stays in gdn until the audit is over, says Ilkay.\n\n"
    texts = [para * 60, "日本語のテキストです。" * 200, "x9" * 3000, "short", "", None, para * 60, "🙂🙃" * 900]
    got = pieces_of(spark, *texts)
    assert set(got) == {0, 1, 2, 6, 7}
    for k, rows in got.items():
        assert [r.piece_no for r in rows] == list(range(len(rows))) and rows[0].tok_start == 0
        assert all(0 < r.tok_end - r.tok_start <= 512 for r in rows)
        assert all(32 <= a.tok_end - b.tok_start <= 35 for a, b in zip(rows, rows[1:]))
        whole = rows[0].text + "".join(b.text[a.char_end - b.char_start :] for a, b in zip(rows, rows[1:]))
        assert whole == texts[k] and all(texts[k][r.char_start : r.char_end] == r.text for r in rows)
        assert all(len(A.encode(r.text)) // 4 <= 512 for r in rows)
    assert all(r.text.endswith("\n\n") for r in got[0])
    assert set(pieces_of(spark, *texts, only_cut=False)) == set(range(8))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n日🙂é", min_size=40, max_size=400))
def test_split_points_are_best(text):
    """The programme against all choices of ends."""
    import numpy as np

    raw = text.encode()
    lengths = [len(A.automaton.labels[i]) for i in A.automaton.encode(text)]
    limit, overlap = 20, 4
    got = splitting.split_points(raw, np.array(lengths), limit, overlap)
    n = len(lengths)
    if n <= limit:
        assert got == [(0, n)]
        return
    off = np.concatenate(([0], np.cumsum(lengths)))
    cost = splitting.cut_penalties(raw, off)
    whole = [i in (0, n) or np.isfinite(cost[i]) for i in range(n + 1)]
    back = lambda e: next(i for i in range(max(e - overlap, 0), -1, -1) if whole[i])
    count = max(1, -(-(n - overlap) // (limit - overlap)))
    even = overlap + (n - overlap) / count

    def price(spans):
        return sum((cost[e] if e < n else 0) + splitting.PIECE + splitting.BALANCE * ((e - s - even) / limit) ** 2 for s, e in spans)

    best = {e: price([(0, e)]) for e in range(overlap + 1, n + 1) if whole[e] and e <= limit}
    for e in range(overlap + 1, n + 1):
        if whole[e] and e > limit:
            best[e] = min((best[p] + price([(back(p), e)]) for p in best if p < e and e - back(p) <= limit), default=float("inf"))
    assert got[-1][1] == n and all(b[0] == back(a[1]) for a, b in zip(got, got[1:]))
    assert price(got) == pytest.approx(best[n])


def plain_price(raw, lengths, limit, overlap, spans=None):
    """Cost of `spans`, or of the best ones by the programme written out for every end and every end before it."""
    import numpy as np

    n = len(lengths)
    off = np.concatenate(([0], np.cumsum(lengths)))
    cost = splitting.cut_penalties(raw, off)
    whole = np.isfinite(cost)
    whole[0] = whole[n] = True
    back = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))
    count = max(1, -(-(n - overlap) // (limit - overlap)))
    even = overlap + (n - overlap) / count
    piece = lambda size: splitting.PIECE + splitting.BALANCE * ((size - even) / limit) ** 2
    if spans is not None:
        return sum((cost[e] if e < n else 0) + piece(e - s) for s, e in spans)
    best = np.full(n + 1, np.inf)
    for e in range(overlap + 1, n + 1):
        if whole[e]:
            fee = cost[e] if e < n else 0
            lo = max(overlap + 1, e - limit)
            p = np.arange(lo, e)
            size = e - back[p - overlap]
            f = np.where(size <= limit, best[lo:e] + piece(size), np.inf)
            best[e] = fee + min(f.min(initial=np.inf), piece(e) if e <= limit else np.inf)
    return best[n]


def test_ends_amid_words_are_left_out():
    """Where words are near, no end amid a word is looked at; where none is near, all are."""
    import numpy as np

    def looked_at(text, limit, overlap):
        raw = text.encode()
        lengths = [len(A.automaton.labels[i]) for i in A.automaton.encode(text)]
        cost = splitting.cut_penalties(raw, np.concatenate(([0], np.cumsum(lengths))))
        return len(lengths), cost, splitting.candidates(cost, np.isfinite(cost), limit, overlap)

    n, cost, ends = looked_at("qzxv jkwq vxzz. " * 300, 512, 32)
    assert ends[-1] == n and len(ends) < 0.6 * n
    assert (cost[ends[5:-1]] < splitting.CHARACTER).all()
    n, _, ends = looked_at("x9" * 3000, 512, 32)
    assert list(ends) == list(range(33, n + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["qzxv", "a", "jkwqvxzz", " ", " ", "\n\n", ". ", ", ", "日本", "。", "🙂", "x9x9x9x9x9x9x9x9x9x9x9"]), min_size=40, max_size=400), st.integers(1, 90))
def test_ends_left_out_are_never_best(parts, block):
    """Against the programme over all positions, at a limit where ends amid words are left out, by blocks of any size."""
    import numpy as np

    raw = "".join(parts).encode()
    lengths = np.array([len(A.automaton.labels[i]) for i in A.automaton.encode("".join(parts))])
    limit, overlap = 64, 8
    assert splitting._widest(limit, overlap) > 3
    if len(lengths) > limit:
        got = splitting.split_points(raw, lengths, limit, overlap, block)
        assert all(0 < e - s <= limit for s, e in got)
        assert plain_price(raw, lengths, limit, overlap, got) == pytest.approx(plain_price(raw, lengths, limit, overlap), abs=1e-9)


def test_short_texts_are_not_encoded(monkeypatch):
    """A text of no more bytes than the limit has no more tokens: no work but to measure it."""
    import pyarrow as pa

    class Frame:
        sparkSession, schema = None, {"k": splitting.T.StructField("k", splitting.T.LongType())}
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    seen = []

    class Table:
        automaton = A.automaton
        encode = lambda self, t: seen.append(t) or A.encode(t)

    monkeypatch.setattr(automaton, "shared_tables", lambda *_: Table)
    texts = ["a b " * 128, "é" * 256, "word " * 600, "a b " * 128 + "!", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["k", "text"])
    (got,) = splitting.split_texts(Frame(), "k")([batch])
    assert seen == texts[2:4] and set(got.column(0).to_pylist()) == {2}


def test_cut_documents_are_best(spark):
    """At the production limit, for documents of the tables and texts without blanks."""
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect()
    texts = [r.text for r in rows] + ["x9" * 3000, "🙂🙃" * 900, "日本語のテキストです。" * 200, "a. " * 700 + "word " * 900 + "\n\n" + "z" * 4000]
    seen = 0
    for t in texts:
        lengths = np.array([len(A.automaton.labels[i]) for i in np.frombuffer(A.encode(t), dtype=np.int32).tolist()])
        if len(lengths) > 512:
            raw = t.encode()
            got = splitting.split_points(raw, lengths, 512, 32)
            assert all(0 < e - s <= 512 for s, e in got)
            assert plain_price(raw, lengths, 512, 32, got) == pytest.approx(plain_price(raw, lengths, 512, 32), abs=1e-9)
            seen += 1
    assert seen > 100


# p2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(f"v{r.randrange(300):03d}", f"v{r.randrange(300):03d}") for _ in range(200)]
    edges += [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(80)] + [("hub", f"s{i}") for i in range(150)] + [(None, "x"), ("lone", "lone")]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.id: r.group_id for r in consolidate.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: root(x) for x in up}


def test_consolidate_edges(spark):
    recs = spark.createDataFrame([(x,) for x in ("b", "c", "d", "e", "e", "Z", "é", None)], "uid string").withColumn("group_id", F.lit("clash"))
    pairs = spark.createDataFrame([("b", "a", 3.0), ("a", "c", -5.0), ("d", "e", -5.1), ("d", "c", None), ("e", "e", 9.0), ("d", "Z", float("nan")), ("é", "Z", 0.0)], "l string, r string, w double")
    got = sorted(tuple(r) for r in consolidate.consolidate(recs, pairs, "uid", "l", "r", "w", -5.0).collect())
    assert got == [("Z", "Z"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "e"), ("é", "Z")]
    assert consolidate.consolidate(recs.limit(0), pairs.limit(0), "uid", "l", "r", "w", -5.0).count() == 0


# p1


def test_survivors(spark):
    trust = spark.createDataFrame([("a", 1, 3), ("b", 2, 1), ("c", 3, 2)], "source string, r1 int, r2 int")
    day = lambda n: T0 + D.timedelta(days=n)
    rows = [
        ("1", "a", day(1), "A1", "n/a"), ("1", "a", day(2), "A2", None), ("1", "b", day(9), "B", " ubuntu "), ("1", "b", day(9), "B", " ubuntu "),
        ("2", "a", day(1), "0000", "Other"), ("2", "c", day(1), "", "--"), ("3", "c", day(1), "C", None), ("3", "c", day(1), "B", "x"), ("3", "new", day(5), "N", "y"), (None, "a", day(1), "q", "q"), ("4", "c", None, "late", None), ("4", "c", day(0), "real", None),
    ]
    df = spark.createDataFrame(rows, "g string, source string, at timestamp_ntz, f1 string, f2 string").withColumn("rank", F.lit(1)).withColumn("v0", F.lit("clash"))
    got = {r.g: (r.f1, r.f2) for r in golden.survivors(df, trust, "g", "source", "at", {"f1": "r1", "f2": "r2"}).collect()}
    assert got == {"1": ("A2", "ubuntu"), "3": ("B", "x"), "4": ("real", None)}
    mart = spark.createDataFrame([("1", " a2", "Debian"), ("2", "n/a", ""), ("5", None, "z")], "g string, f1 string, f2 string")
    best = golden.survivors(df, trust, "g", "source", "at", {"f1": "r1", "f2": "r2"})
    assert sorted(tuple(r) for r in golden.disagreements(mart, best, "g", ["f1", "f2"]).collect()) == [("1", "f2"), ("2", "f1"), ("5", "f2")]
    assert golden.survivors(df.limit(0), trust, "g", "source", "at", {"f1": "r1"}).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_survivors_of_random_groups(spark, seed):
    r = random.Random(seed)
    vals = ["", None, "unknown", "x", "y", "z", "w"]
    ranks = {s: (r.randrange(1, 5), r.randrange(1, 5), r.randrange(1, 5)) for s in "abcde"}
    rows = [(str(r.randrange(30)), r.choice("abcde"), T0 + D.timedelta(days=r.randrange(6)), r.choice(vals), r.choice(vals), r.choice(vals)) for _ in range(600)]
    trust = spark.createDataFrame([(s, *k) for s, k in ranks.items()], "source string, r0 int, r1 int, r2 int")
    df = spark.createDataFrame(rows, "g string, source string, at timestamp_ntz, f0 string, f1 string, f2 string")
    got = {x.g: (x.f0, x.f1, x.f2) for x in golden.survivors(df, trust, "g", "source", "at", {"f0": "r0", "f1": "r1", "f2": "r2"}).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        best = []  # values that are best by trust and time; of several the more complete record's or the smallest
        for i in range(3):
            c = [(ranks[x[1]][i], -x[2].timestamp(), x[3 + i]) for x in rows if x[0] == g and x[3 + i] in ("x", "y", "z", "w")]
            best.append({v for k, t, v in c if (k, t) == min(c)[:2]} if c else {None})
        if best != [{None}] * 3:
            want[g] = best
    assert got.keys() == want.keys()
    assert all(v in w for g in got for v, w in zip(got[g], want[g]))


# p4


RECORD = "uid string, source string, serial string, mac string, name string, ip string, at timestamp_ntz"


def found(spark, rows):
    df = spark.createDataFrame([(*r, T0) for r in rows], RECORD)
    a = linkage.attributes(df, F.col("uid"), "source", "serial", "mac", "name", "ip", "at")
    return {(r.unique_id_l, r.unique_id_r): r.confidence for r in linkage.matches(a).collect()}


def crowd(n):
    """Other devices, one record each."""
    r = random.Random(7)
    word = lambda k: "".join(r.choice("ABCDEFGHJKMNPQRTUVWXY346789") for _ in range(k))
    return [(f"w{i}", "abcd"[i % 4], word(9), f"{r.randrange(16**6):06x}".join(["58", f"{r.randrange(16**4):04x}"]), f"host-{word(7).lower()}", f"10.9.{i // 250}.{i % 250}") for i in range(n)]


def test_matches(spark):
    # a name is common by how many bear it, so others in the crowd are laptops too
    rows = crowd(400) + [(f"l{i}", "abcd"[i % 4], "", "", "laptop", f"10.8.0.{i}") for i in range(40)] + [
        ("a1", "a", "MXM0041GNF", "", "sw830914", ""), ("b1", "b", "SN-MXMOO4IGNF", "f017748f5efc", "sw830914", "10.1.1.1"), ("c1", "c", "", "f017748f5efc", "SW830914-old", "10.1.1.1"), ("d1", "d", "n/a", "", "sw830914", "10.1.1.1"),
        ("a2", "a", "5TKRGBRXW", "584818210ddc", "qro-nb-77", "10.1.1.2"), ("b2", "b", "9PLQZZTTA", "3ce79dc26eb7", "qro-nb-77", "10.1.1.2"),  # a successor
        ("a3", "a", "CNSCTW3SH3", "a4a51f27f309", "lap-3kdq00a", ""), ("b3", "b", "CNSCTW3SH7", "9c29d5f30a4a", "lap-3kdq00b", ""),  # of one batch
        ("a4", "a", "", "02d0c0000000", "dock1user", ""), ("b4", "b", "", "02d0c0000000", "another9", ""),  # one dock
        ("a5", "a", "", "", "laptop", "0.0.0.0"), ("b5", "b", None, None, "laptop", "0.0.0.0"), ("c5", "c", None, None, None, None),
    ]
    got = found(spark, rows)
    assert set(got) == {("a1", "b1"), ("a1", "c1"), ("a1", "d1"), ("b1", "c1"), ("b1", "d1"), ("c1", "d1")}
    assert all(0 <= c <= 1 for c in got.values())


def test_matches_edges(spark):
    assert found(spark, []) == {}
    twins = [(f"a{i}", "a", "SAME12345", "58aabbccdd01", "same-host-1", "10.1.1.1") for i in range(200)] + [(f"b{i}", "b", "SAME12345", "58aabbccdd01", "same-host-1", "10.1.1.1") for i in range(200)]
    assert set(found(spark, twins + crowd(50))) == {("a0", "b0")}
    assert found(spark, [("x", "a", "SAME12345", "", "", "")] * 3 + [("y", "b", "same12345", "", "", "")]).keys() == {("x", "y")}


def test_pruning_is_exact(spark, monkeypatch):
    """Candidates equal those of a comparison of everything with everything."""
    import math

    r = random.Random(3)
    serials, names, ips = [f"SER{r.randrange(10**6):06d}" for _ in range(40)], [f"host{r.randrange(10**5):05d}" for _ in range(30)], [f"10.0.0.{i}" for i in range(12)]
    rows = [(f"u{i}", "abcd"[i % 4], r.choice([*serials, ""]), "", r.choice([*names, ""]), r.choice(ips)) for i in range(150)]
    df = spark.createDataFrame([(*x, T0) for x in rows], RECORD)
    cls = linkage.classes(linkage.attributes(df, F.col("uid"), "source", "serial", "mac", "name", "ip", "at")).cache()
    rows = cls.select("c", "reps", linkage._parts().alias("p")).collect()
    parts = {x.c: {y.part for y in x.p} for x in rows}
    n = sum(len(x.reps) for x in rows)
    df_ = {}
    for x in rows:
        for t in parts[x.c]:
            df_[t] = df_.get(t, 0) + len(x.reps)
    idf = {t: math.log(1 + (n - k + 0.5) / (k + 0.5)) for t, k in df_.items()}
    least = linkage.SHARE * math.log(1 + (n - 1.5) / 2.5)
    want = {(a, b): sum(idf[t] for t in parts[a] & parts[b]) for a in parts for b in parts if a < b}
    want = {k: round(v, 6) for k, v in want.items() if v >= least}
    for hot in (500, 3):  # parts of more than three classes are split
        monkeypatch.setattr(linkage, "HOT", hot)
        got = [(x.a, x.b, round(x.score, 6)) for x in linkage.candidates(linkage.indexed(cls)).collect()]
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want and want


def test_mixture():
    """Weights found in pattern counts of matches and others with known rates, some values missing."""
    r = random.Random(6)
    rates = {1: (0.0, 0.02, 0.08, 0.1, 0.8), 0: (0.0, 0.95, 0.02, 0.02, 0.01)}
    counts: dict[int, int] = {}
    for _ in range(30_000):
        y = int(r.random() < 0.15)
        code = 0
        for _ in range(4):
            code = code * 5 + (0 if r.random() < 0.3 else r.choices(range(5), rates[y])[0])
        counts[code] = counts.get(code, 0) + 1
    m = linkage.mixture(list(counts.items()))
    assert m.prior == pytest.approx(-1.73, abs=0.1)
    for w in m.weights:
        assert w[0] == 0 and w[1] == pytest.approx(-3.86, abs=0.6) and w[2] == pytest.approx(1.39, abs=0.6) and w[4] == pytest.approx(4.38, abs=0.6)
    assert linkage.mixture([]).weights[0][0] == 0


def test_members(spark):
    rows = [(f"a{i}", "a", "SAME12345", "", "", "", T0) for i in range(5)] + [("b1", "b", "SAME12345", "", "", "", T0), ("e1", "a", "", None, "", "", T0), ("e2", "a", "", None, "", "", T0)]
    a = linkage.attributes(spark.createDataFrame(rows, RECORD), F.col("uid"), "source", "serial", "mac", "name", "ip", "at")
    got = {r.unique_id: r.representative for r in linkage.members(a).collect()}
    assert got == {f"a{i}": "a0" for i in range(5)} | {"b1": "b1", "e1": "e1", "e2": "e2"}


def test_calibration():
    r = random.Random(4)
    xs = [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(4000)]
    import math

    ys = [int(r.random() < 1 / (1 + math.exp(-(0.5 + 2 * a - b)))) for a, b in xs]
    w = linkage.calibrate(xs, ys)
    assert abs(w[0] - 0.5) < 0.2 and abs(w[1] - 2) < 0.3 and abs(w[2] + 1) < 0.2
