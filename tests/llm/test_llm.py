"""The training-data operators against the tokenizer libraries, brute force, round trips and held-out labels."""

import math
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glimmer.llm import chat, exact_dedup, language_id, mixing, near_dedup, nearest, packing, revisits, token_counts, token_files
from glimmer.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, kind string"
ODD = [
    (1, "The cat sat on the mat and saw the dog run", "en", "a", 1, "x", "y"),
    (2, None, None, None, None, None, None),
    (3, "", "en", None, 0, "", ""),
    (4, "The cat sat on  the mat and saw the dog run", "en", "a", 1, "x", "y"),
    (5, "  \n \t <|endoftext|> ### </turn> \\ \x1c 中文 ς", "fr", "b", 2, "x", "y"),
    (5, "  \n \t <|endoftext|> ### </turn> \\ \x1c 中文 ς", "fr", "b", 2, "x", "y"),
    (None, "no id", "en", "b", 3, "x", "y"),
    (7, "word " * 30000 + "x" * 5000, "en", "c", 4, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    said, good = compare.check(spark, compare.duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert good, said


def test_token_counts(docs, odd, empty):
    tok = Tokenizer.from_file(BYTE)
    for df in (docs, odd):
        for r in token_counts.count_tokens(df, BYTE).collect():
            t = r["text"] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
            assert r["over_limit"] == (r["n_tokens"] > 512)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


TOK = Tokenizer.from_file(WORD)


def word_ids(text, end):
    return np.array(TOK.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files(docs, odd, empty):
    for df in (docs, odd):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = [], 0
        for d, t in rows:
            ids = word_ids(t, 1)
            want.append((d, at, len(ids), zlib.crc32(ids)))
            at += len(ids)
        assert sorted(map(tuple, token_files.token_file_index(df, WORD).collect()), key=lambda r: r[1]) == want
    assert token_files.token_file_index(empty, WORD).count() == 0


def test_single_documents_by_select(spark, docs, odd, tmp_path, monkeypatch):
    """Over several blocks and parts, with null ids; places that no document has give no row."""
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 50)
    for name, df in (("docs", docs), ("odd", odd)):
        path = str(tmp_path / name)
        token_files.write_token_files(df, WORD, 1, path)
        every = sorted(map(tuple, token_files.read_token_files(spark, path, with_ids=True).select("doc_id", "start", "n_tokens", "ids").collect()), key=lambda r: r[1])
        asked = sorted({0, 1, 6, len(every) // 2, len(every) - 1})
        got = {r[0]: tuple(r[1:]) for r in token_files.read_documents(spark, path, [*asked, 0, -1, len(every)]).collect()}
        assert got == {k: every[k] for k in asked}
    assert token_files.read_documents(spark, path, []).count() == 0


def test_one_id_is_split_over_parts(spark, tmp_path):
    """A null id with most of the rows, and rows that repeat: several parts, rows in order, nothing lost."""
    rows = [(None, f"text {i % 40}") for i in range(2000)] + [(9, "same")] * 2000 + [(10, "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path, small = str(tmp_path / "hot"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # parts of this size would be put together again
    try:
        token_files.write_token_files(df, WORD, 1, path)
    finally:
        spark.conf.set(small, "true")
    parts = spark.read.schema(token_files.BLOCKS).parquet(path).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert len(parts) >= 3 and max(r["n"] for r in parts) < 2000
    got = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 2000 + [9] * 2000 + [10]
    assert Counter(r[2:] for r in got) == Counter((len(ids), zlib.crc32(ids)) for ids in (word_ids(t, 1) for _, t in rows))


def test_elias_fano():
    rng = np.random.default_rng(0)
    for v in ([], [0], [5, 5, 5], np.sort(rng.integers(0, 10**9, 1000)), np.arange(300)):
        ef, used = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.build(np.array(v, np.int64)).to_bytes()))
        assert ef.select(np.arange(len(v))).tolist() == list(v) and [int(ef.select(np.array([i]))[0]) for i in range(len(v))] == list(v)
    data = token_files.EliasFano.build(np.sort(rng.integers(0, 2**40, 4096))).to_bytes()
    assert used and len(data) < 4096 * 5.2


def test_rice_codes():
    rng = np.random.default_rng(1)
    for v in ([], [0], [7, 7], np.sort(rng.integers(0, 1 << 40, 5000))):
        assert exact_dedup.rice_decode(exact_dedup.rice_encode(np.array(v, np.uint64))).tolist() == list(v)


def test_exact_dedup_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()}
    assert got == {(1, 1, 2, True), (4, 1, 2, False), (2, 2, 2, True), (3, 2, 2, False), (5, 5, 2, True), (None, None, 1, True), (7, 7, 1, True)}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_packing(docs, odd, empty):
    for df, cap in ((docs, 4096), (docs, 256), (odd, 4096)):
        rows = packing.pack_documents(df, WORD, capacity=cap).collect()
        texts = Counter((r["doc_id"], len(word_ids(r["text"], 2))) for r in df.collect())
        ids = {r["doc_id"]: word_ids(r["text"], 2) for r in df.collect()}
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for (d, n), got in pieces.items():
            covered = Counter(i for s, k in got for i in range(s, s + k))
            assert set(covered) == set(range(n)) and set(covered.values()) == {texts[d, n]}
        padded = 0
        for got in sequences.values():
            at = 0
            for o, k in sorted(got):
                assert o == at
                at += k
            assert at <= cap
            padded += 0 if at.bit_count() == 1 else cap - at
        if df is docs:
            assert padded < 0.02 * sum(len(x) for x in ids.values())
    assert packing.pack_documents(empty, WORD).count() == 0


def test_best_fill_is_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        items = rng.integers(1, 30, 8).tolist()
        room = int(rng.integers(5, 80))
        best = max(s for s in (sum(x for i, x in enumerate(items) if m >> i & 1) for m in range(256)) if s <= room)
        got = packing.best_fill(Counter(items), room)
        assert sum(got) == best and not Counter(got) - Counter(items)


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    got = {r["doc_id"]: r for r in language_id.identify_languages(odd).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["score"] == 0
    assert language_id.identify_languages(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_schedule_keeps_every_share():
    parts = {"a": 7, "b": 1, "c": 12, "d": 3}
    table = mixing.schedule(parts)
    had = Counter()
    for t, s in enumerate(table, 1):
        had[s] += 1
        assert all(abs(had[k] - t * w / 23) < 1 for k, w in parts.items())
    assert had == parts


def test_mixing(docs, odd, empty):
    parts = {"src0": 5, "src1": 1}
    rows = mixing.mix_sources(docs, parts, block_bytes=2048).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"] and r["block"] * 2048 <= r["first_byte"]
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["source"], r["doc_id"])):
        assert r["first_byte"] == at[r["source"]]
        at[r["source"]] += r["n_bytes"]
    assert len({(r["slot"], r["source"]) for r in rows}) == len({r["slot"] for r in rows})
    assert mixing.in_mixed_order(odd).count() == len(ODD) and mixing.in_mixed_order(odd).columns == odd.columns
    assert mixing.mix_sources(empty).count() == 0


def test_nearest(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = nearest.nearest(v, F.col("vec_id") % 50 == 0).collect()
    names = np.array([r["vec_id"] for r in v.collect()])
    m = np.array([r["embedding"] for r in v.collect()], np.float64)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    hit = total = 0
    for q in names[names % 50 == 0]:
        s = unit @ unit[names == q][0]
        s[names == q] = -2
        best = names[np.lexsort((names, -s))[:5]].tolist()
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(math.isclose(r["score"], s[names == r["vec_id"]][0], rel_tol=1e-12) for r in mine)
        hit += len(set(best) & {r["vec_id"] for r in mine})
        total += 5
    assert hit >= 0.9 * total


def test_nearest_of_odd_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0], "x"), (50, [1.0, 0.0], "x"), (50, [1.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (7, [0.0, 2.0], None), (8, [1.0], "x"), (None, [1.0, 1.0], "x")]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 50), (0, 2, 50), (0, 3, 7), (50, 1, 0), (50, 2, 7)]
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_near_components(odd, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(odd, 4, 85).collect()}
    assert {(1, 8, 1), (4, 8, 1), (2, 0, 2), (3, 0, 3), (None, 1, None)} <= got
    assert near_dedup.near_components(empty).count() == 0


def test_clusters_lose_no_link(spark, docs, monkeypatch):
    plain = sorted(map(tuple, near_dedup.near_components(docs, 4, 85).collect()))
    monkeypatch.setattr(near_dedup, "CLUSTER", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    assert sorted(map(tuple, near_dedup.near_components(docs, 4, 85).collect())) == plain


def test_blocks_of_a_cluster_meet_the_hubs_and_the_rest(spark, monkeypatch):
    """A chain of drifting copies: most reach a hub, the ends only reach their neighbours; two families are not linked."""
    words = [f"w{i}" for i in range(400)]
    chain = [words[3 * k : 3 * k + 120] for k in range(60)]
    far = [["z", *words[k : k + 60], *[f"y{i}" for i in range(80)]] for k in range(0, 40, 2)]
    rows = [(k, " ".join(w)) for k, w in enumerate(chain + far)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")

    def shingles(w):
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    sets, root = [shingles(t.split()) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                i = len(sets[a] & sets[b])
                if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                    root[a] = root[b] = min(root[a], root[b])
    want = sorted([(k, len(s), root[k]) for k, s in enumerate(sets)] + [(k, len(sets[k]), root[k]) for k in range(5)])
    assert 1 < len(set(root)) < len(rows)
    for cluster, block, hubs in ((32, 512, 16), (2, 512, 16), (2, 3, 1), (2, 7, 2)):
        for name, value in (("CLUSTER", cluster), ("BLOCK", block), ("HUBS", hubs)):
            monkeypatch.setattr(near_dedup, name, value)
        assert sorted(map(tuple, near_dedup.near_components(df, 4, 85).collect())) == want


def test_names_of_sets_differ():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 3, 50) for _ in range(500)]
    names = [near_dedup.name_of(s) for s in sets]
    assert len({a for a, _ in names}) == len({b for _, b in names}) == len(sets) and not {a for a, _ in names} & {b for _, b in names}
    assert near_dedup.name_of(sets[-1][::-1]) == names[-1]


def test_revisits(spark):
    rows = [
        (1, "http://A.org/x#f", 10, False, '"v1"', None, {"etag": '"v1"', "content-length": "5", "age": "1"}),
        (2, "https://www.a.org/x/", 20, True, '"v1"', None, {"content-length": "0", "age": "9"}),
        (3, "http://a.org/x", 20, False, '"v2"', "mon", {}),
        (4, "http://a.org/x", 30, True, '"v1"', None, {"age": "2"}),
        (5, "http://a.org/x", 31, True, None, "mon", None),
        (6, "http://a.org/x", 32, True, None, None, None),
        (7, "http://b.org/", 5, True, '"v1"', None, None),
        (8, None, 5, True, '"v1"', None, None),
        (9, "http://a.org/x", None, True, '"v1"', None, None),
        (10, "http://c.org/" + "y" * 9000, 1, False, '"c"', None, {"ETag": "c", "Date": "d1"}),
        (11, "http://c.org/" + "y" * 9000, 2, True, '"c"', None, {"etag": "c", "DATE": "d2"}),
        (11, "http://c.org/" + "y" * 9000, 2, True, '"c"', None, {"etag": "c", "DATE": "d2"}),
    ]
    df = spark.createDataFrame(rows, "capture_id long, url string, ts long, is_revisit boolean, etag string, last_modified string, headers map<string,string>")
    out = revisits.resolve_revisits(df.withColumn("full", F.lit(1)).withColumn("part", F.lit(2))).collect()
    got = {r["capture_id"]: r for r in out}
    assert len(out) == len(rows) and got[11]["headers"] == {"etag": "c", "date": "d2"}
    assert {k: (r["status"], r["source_id"]) for k, r in got.items()} == {1: ("full", None), 2: ("resolved", 1), 3: ("full", None), 4: ("mismatch", None), 5: ("resolved", 3), 6: ("unvalidated", 3), 7: ("missing", None), 8: ("missing", None), 9: ("missing", None), 10: ("full", None), 11: ("resolved", 10)}
    assert got[2]["headers"] == {"etag": '"v1"', "content-length": "5", "age": "9"}
    assert revisits.resolve_revisits(df.where("false")).count() == 0


def test_warc_records():
    body = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\n\r\nhello"
    data = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    assert [(h["warc-type"], b) for h, b in revisits.parse_warc(data + data)] == [("response", body)] * 2


def test_chat_layouts(spark):
    rows = [('{"id":7,"prompt":"p","response":"r"}',), ('{"messages":[]}',), ('{"messages":[{"role":"user","content":"a","name":"n"}],"meta":{"k":[1]}}',), ('{"instruction":"i","input":"x","output":"o"}',), ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}]}',), ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}',), ("not json",), (None,), ('{"other":1}',)]
    got = [r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.canonical_turns(spark.createDataFrame(rows, "record string")).collect()]
    assert got == [[("user", "p"), ("assistant", "r")], [], [("user", "a")], [("user", "i\n\nx"), ("assistant", "o")], [("user", "a"), ("assistant", "")], [("user", "h"), ("assistant", "g")], None, None, None]


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "####", "\\0\\1\\2\\3", "</turn>\n### user: x</turn>\n", "", None, "\\", "a: b"]
    rows = [(1, i, ["user", "assistant", "od: d", None][i % 4], t) for i, t in enumerate(texts)] + [(None, None, None, None)]
    turns = chat.collect_turns(chat.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("z"))))
    back = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[:-1]]
    assert back[1]["loss_text"] == "".join(t or "" for _, _, r, t in rows[:-1] if r == "assistant")
    assert [tuple(t) for t in back[None]["turns"]] == [("", "")]


def test_pipeline(spark, docs):
    """Each stage against a plain version of it on its own input."""
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from glimmer.llm.common import new_path

        path = new_path(spark, "test")
        stage(spark, at, SF).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == docs.columns
        now = {r["doc_id"]: r["text"] for r in at.collect()}
        if name == "language_id":
            assert set(now) == {d for d, t in kept.items() if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            first = {}
            for d in sorted(kept):
                first.setdefault(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", kept[d]), d)
            assert set(now) == set(first.values())
        elif name == "near_dedup":
            sets = {d: set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) or {tuple(t.lower().split())} for d, t in kept.items()}
            order = sorted(sets)
            root = {d: d for d in order}
            for i, a in enumerate(order):
                for b in order[i + 1 :]:
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and root[a] != root[b]:
                        lo, hi = sorted((root[a], root[b]))
                        root = {d: lo if r == hi else r for d, r in root.items()}
            assert set(now) == set(root.values())
        else:
            assert now == kept
        kept = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(kept) and sum(r["length"] for r in pieces) == sum(len(word_ids(t, 2)) for t in kept.values())


def plain_mixture(sizes, parts, block):
    """The mixture's order as (source, position in it), slot by slot: windows and earliest deadlines, from the definition."""
    starts = {s: np.cumsum([0, *v[:-1]]).tolist() for s, v in sizes.items()}
    left = {s: max(1, -(-sum(v) // block)) for s, v in sizes.items()}
    total, done, out = dict(left), dict.fromkeys(left, 0), []
    while left:
        whole, had, slot = sum(parts[s] for s in left), dict.fromkeys(left, 0), 0
        while all(left.values()):
            ready = [s for s in left if had[s] * whole // parts[s] <= slot]
            s = min(ready, key=lambda s: (-(-(had[s] + 1) * whole // parts[s]), s))
            out += [(s, k) for k, at in enumerate(starts[s]) if min(at // block, total[s] - 1) == done[s]]
            had[s], done[s], left[s], slot = had[s] + 1, done[s] + 1, left[s] - 1, slot + 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_written_order_of_mixing_and_packing(spark, monkeypatch):
    from pathlib import Path

    import pyarrow.parquet as pq

    from glimmer.llm.common import new_path

    rows = [(i, "abc de " * (1 + i % 5), "en", f"src{i % 7 % 3}", 0) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    parts, path, out = {"src0": 4, "src1": 2, "src2": 1}, new_path(spark, "test"), new_path(spark, "test")
    monkeypatch.setattr(mixing, "tempered", lambda sizes: parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixing.in_mixed_order(docs, block_bytes=2048).write.parquet(path)
        corpus_pipeline.pack(spark, spark.read.parquet(path), SF).write.parquet(out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [pq.ParquetFile(f).read().column("doc_id").to_pylist() for f in sorted(Path(path).glob("*.parquet"))]
    ids = {s: [r[0] for r in rows if r[3] == s] for s in parts}
    want = [ids[s][k] for s, k in plain_mixture({s: [len(rows[i][1]) for i in v] for s, v in ids.items()}, parts, 2048)]
    assert len(files) > 1 and [d for f in files for d in f] == want
    placed = [(r["sequence_id"], r["offset"], r["doc_id"]) for f in sorted(Path(out).glob("*.parquet")) for r in pq.ParquetFile(f).read().to_pylist()]
    assert placed == sorted(placed)
    groups = [f[i : i + packing.GROUP_DOCS] for f in files for i in range(0, len(f), packing.GROUP_DOCS)]
    assert len(groups) > len(files)
    at = 0
    for g in groups:
        assert {d for _, _, d in placed[at : at + len(g)]} == set(g)
        at += len(g)


def test_language_stage_rejects_only_texts_without_a_letter(spark, odd):
    cols = corpus_pipeline.COLUMNS
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    lettered = sorted((r["doc_id"] or 0, r["text"]) for r in odd.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
    got = corpus_pipeline.identify_languages(spark, bare, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == lettered and {r["lang"] for r in got} == {None}
    marked = odd.withColumn("lang", F.when(F.col("doc_id") == 1, "und"))  # a label that reads like no prediction
    got = corpus_pipeline.identify_languages(spark, marked, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == lettered and {r["lang"] for r in got} == {"und"}
    assert corpus_pipeline.identify_languages(spark, bare.where("false"), SF).columns == cols


def test_listed_blocks_are_the_periodic_schedule():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        names = [f"s{k:02}" for k in range(n)]
        parts = {s: int(rng.choice([1, 1, 2, 3, 10])) for s in names}
        blocks = {s: int(rng.choice([1, 1, 2, 5, 60])) for s in names}
        want = []
        for k, p in enumerate(mixing.phases(blocks, parts)):
            for s, (first, q, at) in p["sources"].items():
                j = 0
                while (slot := j // q * p["total"] + at[j % q]) < p["length"]:
                    want.append((s, first + j, k, p["base"] + slot, p["base"] + j * p["total"] // q, p["base"] - (-(j + 1) * p["total"] // q)))
                    j += 1
        got = list(mixing.listed(blocks, parts))
        assert got == sorted(want, key=lambda r: r[3]) and Counter(r[0] for r in got) == blocks
    assert list(mixing.listed({}, {})) == []


def test_mixing_of_many_sources(spark, docs, monkeypatch):
    many = spark.range(1500).selectExpr("id AS doc_id", "repeat('x', cast(id % 7 AS int)) AS text", "cast(null AS string) AS lang", "concat('s', id % 1100) AS source", "id AS n_chars")
    rows = mixing.mix_sources(many, block_bytes=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1500)) and mixing.in_mixed_order(many).count() == 1500
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert len({(r["slot"], r["source"]) for r in rows}) == len({r["slot"] for r in rows})
    periodic = sorted(map(tuple, mixing.mix_sources(docs, block_bytes=2048).collect()))
    monkeypatch.setattr(mixing, "PERIODIC_SOURCES", 1)
    monkeypatch.setattr(mixing, "LISTED", 100)
    assert sorted(map(tuple, mixing.mix_sources(docs, block_bytes=2048).collect())) == periodic


def test_dedup_decides_by_row(spark):
    rows = [(None, "a b", "en", "s", 3), (None, "a  b", "en", "s", 3), (5, "c d", "en", "s", 3), (5, "c d", "en", "s", 3), (5, "other", "en", "s", 3), (None, "c d", "en", "s", 3), (9, "lone", "en", "s", 3), (None, "alone", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert marks == {(None, None, 2, True): 1, (None, None, 2, False): 1, (5, 5, 3, True): 2, (None, 5, 3, False): 1, (5, 5, 1, True): 1, (9, 9, 1, True): 1, (None, None, 1, True): 1}
    left = [(r["doc_id"], r["text"].replace("  ", " ")) for r in corpus_pipeline.drop_exact_copies(spark, df, SF).collect()]
    assert Counter(left) == {(None, "a b"): 1, (5, "c d"): 1, (5, "other"): 1, (9, "lone"): 1, (None, "alone"): 1}
    far = [" ".join(f"{k}{i}" for i in range(100)) for k in "pqr"]
    rows = [(1, far[0]), (7, far[0] + " end"), (7, "quite another text of seven words here"), (None, far[1]), (None, far[1] + " end"), (3, far[2] + " end"), (None, far[2]), (4, far[2] + " x"), (3, far[2] + " end")]
    near = spark.createDataFrame([(d, t, "en", "s", 3) for d, t in rows], df.schema)
    left = Counter((r["doc_id"], r["text"].removesuffix(" end")) for r in corpus_pipeline.drop_near_copies(spark, near, SF).collect())
    assert left == {(1, far[0]): 1, (7, rows[2][1]): 1, (None, far[1]): 1, (3, far[2]): 1}


def test_character_classes_are_the_librarys(spark):
    """Every code point, before an ending and between letters and digits: counts of the merger and of the library."""
    tok, counter = Tokenizer.from_file(BYTE), token_counts.TokenCounter(BYTE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 1 << 16):
        texts = [f"{chr(c)}'s a{chr(c)}1 {chr(c)} x" for c in points[i : i + (1 << 16)]]
        assert counter.counts(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_rows_are_picked_file_by_file_too(spark, docs, monkeypatch):
    """Past the limits of what is broadcast, the same rows come out."""
    from glimmer.llm import common

    many = common.stage(docs.repartition(5), "test")
    plain = [sorted(map(tuple, f(many).collect()), key=str) for f in (exact_dedup.exact_dedup, exact_dedup.drop_duplicates, lambda d: near_dedup.near_components(d, 4, 85), lambda d: corpus_pipeline.drop_near_copies(spark, d, SF), mixing.in_mixed_order)]
    monkeypatch.setattr(common, "PICK_ROWS", 3)
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    assert [sorted(map(tuple, f(many).collect()), key=str) for f in (exact_dedup.exact_dedup, exact_dedup.drop_duplicates, lambda d: near_dedup.near_components(d, 4, 85), lambda d: corpus_pipeline.drop_near_copies(spark, d, SF), mixing.in_mixed_order)] == plain


def brute_recall(vectors, k, **options):
    lines = nearest.SortedLines(vectors, **options)
    asked = np.arange(0, len(vectors), 50)
    found = lines.search(vectors[asked], [np.array([q]) for q in asked], np.arange(len(vectors)), k)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hit = 0
    for q, (at, score) in zip(asked, found, strict=True):
        s = unit @ unit[q]
        s[q] = -2
        hit += len(set(at.tolist()) & set(np.argsort(-s)[:k].tolist()))
        assert np.allclose(score, s[at])
    return hit / (k * len(asked)), lines.verified / (len(asked) * len(vectors))


def test_recall_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (2000, 20000):
        recall, verified = brute_recall(rng.standard_normal((n, 64)), 5)
        assert recall >= 0.9 and verified < 0.6, (n, recall, verified)
    centres = rng.standard_normal((40, 64))
    recall, verified = brute_recall(centres[rng.integers(0, 40, 8000)] + 0.5 * rng.standard_normal((8000, 64)), 5)
    assert recall >= 0.9 and verified < 0.2, (recall, verified)


def test_mixture_against_slots(spark):
    """Order and slots of documents by a plain earliest-deadline run over a table whose sources run out."""
    rng = np.random.default_rng(9)
    rows = [(i, "z" * int(rng.integers(0, 900)), ["a", "b", None][int(rng.choice(3, p=[0.7, 0.25, 0.05]))]) for i in range(600)]
    parts = {"a": 3, "b": 5, "": 2}
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), parts, 1000).orderBy("slot", "source", "first_byte", "doc_id").collect()
    sizes, ids = defaultdict(list), defaultdict(list)
    for d, t, s in rows:
        sizes[s or ""].append(len(t))
        ids[s or ""].append(d)
    assert [(r["source"], r["doc_id"]) for r in got] == [(s, ids[s][k]) for s, k in plain_mixture(dict(sizes), parts, 1000)]


def plain_language(train, texts):
    """The same code and decoding with dictionaries of gram counts instead of bucket tables."""
    langs = sorted({lang for _, lang in train})
    code = language_id.codewords(len(langs))
    counts = {k: [Counter(), Counter()] for k in langs}

    def grams(text):
        data = f" {text.lower()} ".encode()
        three, two = language_id.grams(np.frombuffer(data, np.uint8))
        return three.tolist(), two.tolist()

    for text, lang in train:
        for half, g in enumerate(grams(text)):
            counts[lang][half].update(g)
    p = lambda k, half, g: (counts[k][half][g] + 0.5) / (sum(counts[k][half].values()) + 0.5 * language_id.BUCKETS)
    totals = {}

    def odds(half, g):
        if (half, g) not in totals:
            ps = np.array([p(k, half, g) for k in langs])
            totals[half, g] = [(np.log(ps[code[:, b] > 0].mean()) - np.log(ps[code[:, b] < 0].mean())) / 2 for b in range(code.shape[1])]
        return totals[half, g]

    out = []
    for text in texts:
        pairs = list(zip(*grams(text), strict=True))
        out.append(np.mean([np.add(odds(0, a), odds(1, b)) for a, b in pairs], axis=0) if pairs else np.zeros(code.shape[1]))
    return np.array(out)


def test_language_margins_against_plain_counts(spark, docs):
    rows = [(r["text"], r["lang"]) for r in docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) < 400").collect()]
    model = language_id.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"), sample_per_lang=10**6)
    texts = [t for t, _ in rows[:40] if len(t) > 2]
    assert np.allclose(model.margins(texts), plain_language(rows, texts), atol=1e-4)


def test_languages_of_any_number(spark):
    words = {f"l{k}": [f"{chr(97 + k)}{chr(97 + (k * 7 + j) % 26)}{chr(97 + (k + 3 * j) % 26)}" for j in range(6)] for k in range(9)}
    rows = [(i, " ".join(words[f"l{i % 9}"][(i + j) % 6] for j in range(30)), f"l{i % 9}") for i in range(180)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(df).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows)
    long = df.where("doc_id = 0").withColumn("text", F.repeat("text", 4000))
    one = language_id.fit(df.where("lang = 'l3'"))
    assert one.predict(["x", "", "1"]) [0] == ["l3", "und", "und"]
    assert language_id.fit(df).predict([long.first()["text"]])[0] == [rows[0][2]]


def test_links_at_the_edge_of_the_threshold(spark):
    """100 * common = 85 * union links, one shingle less does not."""
    words = [f"w{i}" for i in range(200)]
    a = words[:103]  # 100 shingles of four words
    rows = [(1, a), (2, a[:88]), (3, words[100:] + ["q"]), (4, (words[100:] + ["q"])[:86])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string"), 4, 85).collect()}
    assert got == {1: (100, 1), 2: (85, 1), 3: (98, 3), 4: (83, 4)}


def test_columns_of_clashing_names(spark):
    extra = {c: F.lit(1) for c in ("_row", "_keep", "_sha", "_s", "_d", "_slot", "_at", "_stays", "row", "part", "slot", "print", "_lines", "node", "bucket")}
    df = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "a  b c", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string").withColumns(extra)
    assert {r["doc_id"] for r in exact_dedup.drop_duplicates(df).where("text IS NOT NULL").collect()} == {1} and exact_dedup.drop_duplicates(df).columns == df.columns
    assert mixing.in_mixed_order(df).columns == df.columns and mixing.in_mixed_order(df).count() == 3
    assert near_dedup.near_components(df).count() == exact_dedup.exact_dedup(df).count() == packing.pack_documents(df, WORD).count() == token_files.token_file_index(df, WORD).count() == 3
    turns = chat.collect_turns(chat.turn_rows(df.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text", "_lines")))
    assert chat.read_chat(chat.format_chat(turns.withColumn("_lines", F.lit("z")))).select("_lines").distinct().count() == 1


def test_pipeline_stages_on_odd_tables(spark, empty):
    cols = corpus_pipeline.COLUMNS
    rows = [(None, "one two three four five six", None, None, 1), (None, "one two three four five six", None, None, 1), (5, "sieben acht neun", "de", "b", 2), (5, "sieben acht neun", "de", "b", 2), (6, None, "de", "b", 0), (7, "", None, None, 0)]
    from glimmer.llm.common import stage

    for df, left in ((empty.select(*cols), 0), (spark.createDataFrame(rows, empty.select(*cols).schema), 2)):
        for name, f in corpus_pipeline.STAGES:
            df = stage(f(spark, stage(df, "test"), SF), f"test-{name}")
        assert df.count() == left


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A session that was started elsewhere and without a path setting."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from glimmer.llm.queries import QUERIES
for name in ("op3_nearest", "op8_packing"):
    print(name, QUERIES[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    tokenizers = str(Path(public_tokenizers.__file__).parent)
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.append({tokenizers!r})\n{code}"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "op8_packing" in done.stdout, done.stderr[-2000:]


def test_dedup_of_many_groups_and_hot_texts(spark, monkeypatch):
    """Beyond a broadcast of groups, with texts that many rows hold (one of them without any id), the rows are the same."""
    rows = [(i, "hot  text") for i in range(300)] + [(None, "no id")] * 150 + [(1000 + i, f"t{i % 40}") for i in range(100)] + [(5000 + i, f"own {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=key)
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 5)
    monkeypatch.setattr("glimmer.llm.common.HOT_ROWS", 20)
    got = sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=key)
    assert got == want and len(got) == 600
    sizes = Counter((r[2], r[3]) for r in got)
    assert sizes[300, True] == 1 and sizes[300, False] == 299 and sizes[150, True] == 1 and sizes[150, False] == 149 and sizes[1, True] == 50


def test_warc_files_in_parts(spark, tmp_path):
    """Parts begin at records only, also where a body looks like one; gzip members, an empty file, records without a body."""
    import gzip

    def record(n, body):
        block = b"HTTP/1.1 200 OK\r\nETag: e%d\r\n\r\n" % n + body
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/%d\r\nWARC-Date: 2020\r\nContent-Length: %d\r\n\r\n" % (n, len(block)) + block + b"\r\n\r\n"

    bodies = [b"" if n % 5 == 0 else b"x" * (n * 7) if n % 2 else b"\r\n\r\n" + record(n, b"inner") * 3 for n in range(60)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a b.warc").write_bytes(info + b"".join(record(n, b) for n, b in enumerate(bodies)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [info, *(record(n, b) for n, b in enumerate(bodies))]))
    (tmp_path / "d.warc").write_bytes(b"")
    spans = list(revisits.spans_of(str(tmp_path / "a b.warc"), 1500))
    assert len(spans) > 5 and [a[2] for a in spans[:-1]] == [b[1] for b in spans[1:]] and len(list(revisits.spans_of(str(tmp_path / "c.warc.gz"), 1500))) == 1
    for size in (1, 1500, 1 << 30):
        got = sorted((r["file"].rsplit("/", 1)[-1], r["position"], r["url"], r["etag"], bytes(r["body"])) for r in revisits.read_warc(spark, str(tmp_path), size).collect())
        assert got == sorted((f, n + 1, f"http://a/{n}", f"e{n}", b) for f in ("a b.warc", "c.warc.gz") for n, b in enumerate(bodies))


def test_warc_files_are_read_in_spark(spark, tmp_path):
    def record(kind, uri, block, extra=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-01-01\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    data = record("response", "http://a/", b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nhi") + record("response", "http://b/", b"HTTP/1.1 404 No\r\n\r\nno") + record("revisit", "http://a/", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n") + record("revisit", "http://a/", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
    (tmp_path / "x.warc").write_bytes(data)
    got = [(r["url"], r["is_revisit"], r["status"], r["etag"], r["body"] and bytes(r["body"])) for r in revisits.read_warc(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == [("http://a/", False, 200, "x", b"hi"), ("http://a/", True, 304, None, None)]


@pytest.mark.parametrize("ids", ["cast(id as long)", "3L", "40L", "cast(null as long)"])
def test_language_id_with_repeated_or_missing_ids(spark, ids):
    """Whatever the ids, both languages are learned, also from one row that is repeated."""
    rows = spark.range(600).selectExpr(f"{ids} AS doc_id", "if(id % 2 = 0, concat('the cat and the dog ', id), concat('der hund und die katze ', id)) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    model = language_id.fit(rows, 50)
    assert model.langs == ["de", "en"] and model.predict(["the dog and the cat", "die katze und der hund"])[0] == ["en", "de"]
    one = rows.where("lang = 'en'").unionByName(spark.range(5000).selectExpr("7L AS doc_id", "'der hund' AS text", "'de' AS lang"))
    assert language_id.fit(one, 50).langs == ["de", "en"]
    assert language_id.identify_languages(rows).count() == 600


def test_learned_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGS", 2)
    rows = [(i, f"text {i}", k) for k, n in (("a", 5), ("b", 1), ("c", 3), ("d", 1)) for i in range(n)]
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["a", "c"]


@pytest.mark.parametrize("n", [2, 20, 500, 1000, 5000])
def test_shares_of_unequal_sources(n):
    sizes = {0: 1e12} | {k: 1e3 for k in range(1, n)}
    parts, raw = mixing.tempered(sizes), {k: v**0.5 for k, v in sizes.items()}
    assert min(parts.values()) >= 1
    assert all(abs(parts[k] / sum(parts.values()) - raw[k] / sum(raw.values())) <= 1 / mixing.PARTS for k in sizes)
