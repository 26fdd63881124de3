"""Defined cases and brute-force comparisons of the operators on small inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, components, jaccard_join, language_id, near_vectors, packing, piece_codec, quality_model, quality_rules, repeat_spans, toxicity
from sparkloom.llm.shared import byte_view
from sparkloom.llm.shingles import shingle_sets

DOC = "doc_id long, text string, lang string, source string, n_chars long, ka string, seq string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def documents(spark, texts):
    rows = [(i, t, "en", "s0" if (i or 0) % 2 else None, None, "clash", "clash") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "one two"), (9, prose(2, 3000)), (9, prose(3, 60)), (None, base), (11, "é" * 300 + " " + base), (12, "x " * 400), (2, base), (None, None)]


def empty(spark):
    return documents(spark, [(0, "x")]).where("false")


# Chat formatting.


def test_escapes_are_reversible():
    parts = ["\\", "<|", "|>", "<|turn|>", "<|text|>", "<|end|>", "</s>[INST]", "a", "é", "<", "|", "\n"]
    for texts in itertools.islice(itertools.product(parts, repeat=3), 0, None, 7):
        messages = [("user", "".join(texts)), ("assistant", texts[0]), ("odd<|end|>role", texts[1])]
        formatted, spans = chat_format.rendered(messages)
        assert chat_format.parsed(formatted) == messages
        assert [chat_format.unescaped(formatted[a:b]) for a, b in spans] == [texts[0]]


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", "assistant", "llo"), (1, 3, 0, "edit", "user", "hi!"),
        (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "new"), (2, 0, 0, "message", None, None), (None, 0, None, "message", "user", "x"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string").withColumn("extra", F.lit(1))
    got = {r["conv_id"]: chat_format.parsed(r["formatted"]) for r in chat_format.format_conversations(events).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "new")], 2: [("", "")], None: [("user", "x")]}
    bad = events.withColumn("kind", F.lit("what"))
    with pytest.raises(Exception, match="unknown event"):
        chat_format.format_conversations(bad).collect()
    assert chat_format.format_conversations(events.where("false")).count() == 0


def plain_fold(events):
    """Messages of one conversation by looking at each turn's own events; for logs where every turn begins once."""
    order, out = [], {}
    for _, turn, kind, role, text in sorted(events):
        if turn not in out:
            order.append(turn)
            out[turn] = ["", ""]
        out[turn][0] = role or out[turn][0]
        out[turn][1] = {"message": text, "edit": text, "regenerate": "", "delta": out[turn][1] + text}[kind]
    return [tuple(out[t]) for t in order]


def test_random_logs_against_a_plain_fold(spark):
    r = random.Random(8)
    logs = {}
    for conv in range(40):
        seq, events = 0, []
        for turn in range(r.randrange(1, 6)):
            role = "assistant" if turn % 2 else "user"
            events.append((seq, turn, r.choice(["message", "delta"]), role, prose(seq, 3)))
            for _ in range(r.randrange(5)):
                seq += 1
                kind = r.choice(["delta", "delta", "edit", "regenerate"])
                events.append((seq, r.randrange(turn + 1), kind, r.choice(["", role]) if kind != "edit" else "", r.choice(["", "<|end|>", "\\<|", prose(seq, 2)])))
            seq += 1
        logs[conv] = events
    rows = [(c, *e) for c, events in logs.items() for e in events]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(7)
    got = {x["conv_id"]: x for x in chat_format.format_conversations(df).collect()}
    for conv, events in logs.items():
        messages = plain_fold(events)
        assert chat_format.parsed(got[conv]["formatted"]) == messages
        spans = [chat_format.unescaped(got[conv]["formatted"][s["start"] : s["end"]]) for s in got[conv]["loss_spans"]]
        assert spans == [t for role, t in messages if role == "assistant"]


def test_a_long_conversation_and_ties(spark):
    df = spark.range(30_000).select(F.lit(1).alias("conv_id"), (F.col("id") / 2).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), F.col("id") % 2).alias("text"), F.lit(0).alias("seq"))
    got = {r["conv_id"]: r for r in chat_format.op2_chat_format(spark, df).collect()}
    assert got[1]["n_turns"] == 30_000 and got[1]["loss_sha256"] == hashlib.sha256(b"t0t1" * 15_000).hexdigest()
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_sha256"] == hashlib.sha256(chat_format.PLANTED_TEXT.encode()).hexdigest()


# Near duplicates.


def brute_components(texts, threshold=80):
    def shingles(t):
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(root(k), []).append(texts[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((texts[k][0], len(sets[k]), least[root(k)]) for k in range(len(texts))), key=str)


def test_jaccard_odd_cases(spark, odd):
    got = sorted((tuple(r) for r in jaccard_join.op10_jaccard_join(documents(spark, odd)).collect()), key=str)
    # Texts without words keep their own id, null or not.
    assert got == brute_components(odd)
    assert jaccard_join.op10_jaccard_join(empty(spark)).count() == 0


def test_jaccard_chains_and_borders(spark):
    r = random.Random(4)
    texts, base = [], prose(9, 60).split()
    for k in range(60):
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            words[r.randrange(len(words))] = f"w{r.randrange(1000)}"
        texts.append((k, " ".join(words)))
    got = sorted((tuple(r) for r in jaccard_join.op10_jaccard_join(documents(spark, texts)).collect()), key=str)
    assert got == brute_components(texts)


def test_one_of_each(spark, odd):
    kept = jaccard_join.one_of_each(documents(spark, odd)).collect()
    # 2, 3, 11 and a null id are near copies of 1, and 8 is one of 7.
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, [1, 4, 5, 6, 7, 9, 9, 12, None]))
    assert jaccard_join.one_of_each(empty(spark)).count() == 0


def reached(links):
    """Each end of the links with the least end that it can reach."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_trie_join_against_all_pairs():
    r = random.Random(1)
    classes = np.zeros(1 << jaccard_join.BIN_BITS, np.int8)
    classes[::7] = 3
    for _ in range(120):
        members = []
        for group in range(r.randrange(1, 5)):
            base = [r.getrandbits(64) for _ in range(r.randrange(1, 40))]
            for _ in range(r.randrange(1, 50 if group == 3 else 12)):
                own = {x for x in base if r.random() < r.choice([0.85, 0.95, 1])} or {1}
                own |= {r.getrandbits(64) for _ in range(r.randrange(4))}
                members.append((group, r.randrange(3), r.randrange(30), np.array(sorted(own), np.uint64)))
        want = []
        for a, b in itertools.permutations(members, 2):
            x, y = set(a[3].tolist()), set(b[3].tolist())
            if a[0] == b[0] and a[1] != 1 and b[1] and a[2] != b[2] and 100 * len(x & y) >= 80 * len(x | y):
                want.append((a[2], b[2]))
        assert reached(jaccard_join.tied(members, classes, 80)) == reached(want)


@pytest.mark.parametrize("bound", [2, 128])
def test_jaccard_groups_beyond_every_bound(spark, monkeypatch, bound):
    """Cells, lists and batches of two: a group of near copies is cut everywhere, and stays whole."""
    for name in ("CHUNK", "LIST", "WALKERS", "BATCH_GRAMS", "PIECE_GRAMS", "KNOWN_TEXTS"):
        monkeypatch.setattr(jaccard_join, name, bound)
    r = random.Random(bound)
    texts, base = [], prose(19, 50).split()
    for k in range(90):
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            words[r.randrange(len(words))] = f"w{r.randrange(10)}"
        texts.append((k, " ".join(words)))
    got = sorted((tuple(x) for x in jaccard_join.op10_jaccard_join(documents(spark, texts)).collect()), key=str)
    assert got == brute_components(texts)


def test_shingles_match_python():
    texts = ["A b c d e F", "", "a b", " x\ty\nz  w v u ", "a a a a a a a"]
    data, offsets = byte_view(pa.array(texts))
    sizes = [n for _, _, _, b in shingle_sets(data, offsets) for n in np.diff(b)]
    assert sizes == [2, 0, 1, 2, 1]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated spans.


def brute_spans(texts, width):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for (doc, _), d in zip(texts, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((doc, len(d), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_runs", [2000, 1])
def test_spans_against_brute_force(spark, odd, monkeypatch, most_runs):
    monkeypatch.setattr(repeat_spans, "MOST_RUNS", most_runs)
    monkeypatch.setattr(repeat_spans, "SHARD_BYTES", 2000)
    passage = prose(77, 60)
    texts = [*odd, *((100 + k, f"{prose(200 + k, 30 + k)} {passage[k : 400 + 3 * k]} {prose(300 + k, 20)}") for k in range(12)), (150, "ab" * 500), (151, "é" * 199), (152, "y" * 199), (153, "y" * 200), (154, "z" * 201)]
    got = sorted((tuple(r) for r in repeat_spans.op9_repeat_spans(documents(spark, texts)).collect()), key=str)
    assert got == brute_spans(texts, 200)


def test_spans_keep_columns(spark, odd):
    df = documents(spark, odd)
    out = repeat_spans.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(odd)
    assert [r["text"] for r in out.where("doc_id = 4").collect()] == [None]
    assert repeat_spans.without_repeats(empty(spark)).count() == 0


def test_runs_are_merged_by_binary_search():
    r = random.Random(3)
    for _ in range(30):
        runs, seen = [], Counter()
        for shard in range(r.randrange(1, 6)):
            keys = sorted({bytes([r.randrange(3), r.randrange(8), 0]) for _ in range(r.randrange(0, 12))})
            seen.update(keys)
            runs.append([(k, shard, k[0] * 8 + k[1]) for k in keys])
        made = [(np.array([k for k, _, _ in x], "S16"), np.array([s for _, s, _ in x], np.int64), np.array([p for _, _, p in x], np.int64), np.zeros(len(x), bool)) for x in runs]
        found = []
        while len(made) > 1:
            one, some = repeat_spans.merged_pair(made[0], made[1])
            made, found = [*made[2:], one], found + some
        assert sorted(found) == sorted((s, p) for x in runs for k, s, p in x if seen[k] > 1)
        assert (made[0][0][1:] > made[0][0][:-1]).all() and len(made[0][0]) == len(seen)


def test_suffix_array_and_prefixes():
    r = random.Random(0)
    for n in (1, 2, 50, 400):
        text = np.array([r.choice([97, 98]) for _ in range(n)], np.uint8)
        order, rank = repeat_spans.suffix_array(text, 1024)
        b = text.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = repeat_spans.common_prefixes(text, order, rank, np.array([0]), np.array([n]), 1024)
        for k in range(1, n):
            x, y = b[order[k - 1] :], b[order[k] :]
            assert lcp[k] == len(os.path.commonprefix([x, y]))


# Vectors.


def test_lattice_points():
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    p = near_vectors.decoded(x)
    assert np.allclose((p * 2) % 1, 0) and (np.isclose(p.sum(1) % 2, 0)).all()
    d = ((x - p) ** 2).sum(1)
    assert (d <= ((x[:, None] - (p[:, None] + near_vectors.ROOTS)) ** 2).sum(2).min(1) + 1e-9).all() and len(near_vectors.ROOTS) == 240


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows, base = [], r.normal(size=(40, 64))
    for i in range(300):
        v = base[i % 40] + r.normal(size=64) * r.choice([0.05, 0.2, 0.3])
        rows.append((i, v.tolist(), int(i % 2), "x"))
    rows += [(300, rows[0][1], 0, "x"), (301, None, 0, "x"), (302, [0.0] * 64, 0, "x"), (303, [math.nan] * 64, 0, "x"), (304, rows[0][1], None, "x"), (305, [None] + [1.0] * 63, 0, "x"), (306, [1.0, 2.0], 1, "x"), (307, [2.0, 4.0], 1, "x"), (308, rows[0][1][:63] + [math.inf], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid string")
    good = [(i, np.array(v), k) for i, v, k, _ in rows if v and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    got = {x["vec_id"]: x for x in near_vectors.op1_near_vectors(df).collect()}
    want = Counter(x for p in pairs for x in p)
    assert sum(x["n_links"] for x in got.values()) >= 0.99 * sum(want.values())
    assert all(got[i]["n_links"] <= want[i] for i in got)
    assert got[300]["component_id"] == 0 and got[306]["n_links"] == 1 and all(got[i]["component_id"] == i and got[i]["kept"] for i in (301, 302, 303, 304, 305, 308))
    assert near_vectors.op1_near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize(("block", "n"), [(512, 700), (16, 150)])
def test_full_cells_against_brute_force(spark, monkeypatch, block, n):
    """One dense group in every table's cell, cut into blocks: links, components and what is kept are all as by brute force."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    r = np.random.default_rng(block)
    centre = r.normal(size=32)
    x = centre + r.normal(size=(n, 32)) * r.choice([0.02, 0.1], size=(n, 1))
    x[: n // 10] = centre + r.normal(size=(n // 10, 32)) * 0.3
    ids = r.permutation(n).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 7) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= near_vectors.THRESHOLD
    np.fill_diagonal(near, False)
    got = {x["vec_id"]: x for x in near_vectors.op1_near_vectors(df).collect()}
    links = sum(got[i]["n_links"] for i in ids)
    assert 0.97 * near.sum() <= links <= near.sum() and all(got[i]["n_links"] <= near[k].sum() for k, i in enumerate(ids))
    root = reached([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    same = [got[i]["component_id"] == root.get(i, i) for i in ids]
    assert np.mean(same) > 0.97 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.01, 1.0], 0)]
    got = near_vectors.op1_near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 5 and {r["component_id"] for r in got} == {1}


# Pieces.


def small_codec(n_best):
    pieces = {c: (-5.0 - k, k) for k, c in enumerate("abc .")} | {"ab": (-4.0, 10), "bc": (-4.5, 11), " a": (-3.0, 12), "abc": (-8.5, 13)}
    return piece_codec.PieceCodec.of(pieces, {b: 100 + b for b in range(256)}, n_best)


def test_n_best_against_enumeration():
    for n in (1, 3, 5):
        codec = small_codec(n)
        for text in ["", "a", "abc", "abcabc", "a b", "ab.c  abc", "é", "a\nb", "zzz"]:
            edges = codec.edges(f" {text}" if text else "")

            def every(at, edges=edges):
                if not at:
                    return [(0.0, ())]
                return [(s + score, ids + own) for i, score, own in edges[at] for s, ids in every(i)]

            want = sorted((s for s, _ in every(len(edges) - 1)), reverse=True)[:n]
            got = codec.encode(text)
            assert np.allclose([s for s, _ in got], want) and all(codec.decode(ids) == text for _, ids in got)
            assert len({ids for _, ids in got}) == len(got)


def test_real_model_against_a_plain_lattice():
    """The two best paths by a plain dynamic program over whole texts, without cuts, table or A*; ties and tiny tables included."""
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", " ", "  two  spaces ", "Größe, naïve façade!", "line\n\n next\tline", "日本語 and \U0001f600", "aaaaaaaaaaaa", "▁mark", prose(5, 40), "x" * 300]
    codecs = [piece_codec.PieceCodec(path, 2), piece_codec.PieceCodec(path, 2, most=3)]
    for text in [*texts, *texts]:
        edges = codecs[0].edges(f" {text}" if text else "")
        best = [[0.0]]
        for into in edges[1:]:
            best.append(sorted((s + score for i, score, _ in into for s in best[i]), reverse=True)[:2])
        for codec in codecs:
            got = codec.encode(text)
            assert [s for s, _ in got] == best[-1] and all(codec.decode(ids) == text for _, ids in got)
        assert codecs[0].encode(text) == codecs[1].encode(text)
    assert len(codecs[1].parts.slot) < len(codecs[0].parts.slot)


def test_encoded_tables(spark, odd):
    df = documents(spark, odd)
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    got = piece_codec.op4_piece_codec(df).collect()
    assert {(r["doc_id"], r["rank"]) for r in got} >= {(i, 0) for i, _ in odd} and all(r["decoded_ok"] for r in got)
    assert sum(r["rank"] == 0 for r in got) == len(odd) and [r["n_ids"] for r in got if r["doc_id"] in (4, 5)] == [0, 0]
    rows = piece_codec.decoded(piece_codec.encoded(df.where("doc_id = 1"), path, 2), path).collect()
    assert len(rows) == 2 and all(r["text"] == odd[0][1] for r in rows)
    assert piece_codec.op4_piece_codec(empty(spark)).count() == 0


def test_piece_codec_query_gives_every_path(spark):
    import public_tokenizers

    from sparkloom.llm import queries as q

    data = "/root/testdata/sf0.001"
    codec = piece_codec.PieceCodec(str(public_tokenizers.path("piece_bpe_32k.model")))
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        for rank, (score, ids) in enumerate(codec.encode(r["text"] or "")):
            assert codec.decode(ids) == (r["text"] or "")
            want[r["doc_id"], rank] = (score, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert {rank for _, rank in want} == {0, 1, 2}
    got = q.op4_piece_codec(spark, data).collect()
    assert {(r["doc_id"], r["rank"]): (r["score"], r["n_ids"], r["ids_crc32"], r["decoded_ok"]) for r in got} == want and len(got) == len(want)


# Packing.


def test_nnls():
    r = np.random.default_rng(1)
    for _ in range(10):
        a, b = r.random((8, 12)), r.random(8) * 10
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and g.max() < 1e-6 and np.allclose(g[x > 1e-9], 0, atol=1e-6)


def test_packing_is_whole(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = packing.op6_packing(documents(spark, [(k, t) for k, (_, t) in enumerate(odd)]).repartition(2)).collect()
    whole = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    whole.encode_special_tokens = True
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for own in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert ends[:-1] == sorted(o for o, _ in own) and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
    for k, (_, text) in enumerate(odd):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[k], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1] and sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.op6_packing(empty(spark)).count() == 0


def test_word_ids_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkloom.llm.word_ids import WordIds

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    own, whole = WordIds(path, most=10), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    for text in ["", "İSTANBUL ΣΊΣ", "it's 'S don't'll 12½", "<|endoftext|> <|startoftext|>x", "\x1ca\x85b\xa0c", "日本語 ﬁ K é", "a\tb\x0bc", "'' ''s", "Ünïcödé.Straße,x"]:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


# Models.


def test_folding():
    assert toxicity.folded("1D10T, Іdіоt! ídïot 2024 i​diot") == " idiot idiot idiot idiot "


def test_toxicity_folds_every_sign():
    for sign in "\u201c\u201d\u2019\u2014\u2013\u2026\u2022\u3001\U0001f600":
        assert toxicity.folded(f"so{sign}idiot{sign}he") == " so idiot he "
    assert toxicity.folded("\u4f60idiot \U0001d422diot") == " idiot idiot "
    lexicon = toxicity.Lexicon({" stupid": 1.0, " ass ": 1.0, " idiot ": 1.0})
    for text in ("$tupid", "@ss", "@idiot", "!idiot!", "an \u201cidiot\u201d", "\u2014stupid"):
        assert lexicon.mass(text)[0] == 1.0


def test_toxicity_training_merges_copies_only():
    rows = [(f"text {'abcdefghij'[k]} under this disclaimer", 0) for k in range(10)]
    assert len({toxicity._copy_key(*row) for row in rows}) == 10
    assert len({toxicity._copy_key("The  Same text", y) for y in (0, 1)} | {toxicity._copy_key("the same text", 1)}) == 2
    assert toxicity._copy_key("你好", 0) != toxicity._copy_key("再见", 0)


def test_toxicity(spark):
    r = random.Random(1)
    clean = [" ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(40)) for _ in range(300)]
    bad = [c.replace(" ", " nastyword ", 1) if k % 2 else c.replace(" ", " vilestem" + r.choice(WORDS) + " ", 1) for k, c in enumerate(clean[:120])]
    texts = [(k, t) for k, t in enumerate(clean + bad)]
    labels = spark.createDataFrame([(k, 0, int(k >= 300)) for k, _ in texts] + [(9999, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    more = [(5000, None), (5001, ""), (None, "n4styw0rd"), (5002, "NASTYWORD " * 3)]
    got = toxicity.op7_toxicity(documents(spark, texts + more), labels).collect()
    assert len(got) == len(texts) + 4
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["predicted"] == int(r["doc_id"] >= 300) for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["predicted"] == by[5001]["predicted"] == 0 and by[5002]["predicted"] == 1 and by[None]["predicted"] == 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert toxicity.op7_toxicity(empty(spark), labels).count() == 0
    assert toxicity.op7_toxicity(documents(spark, more), labels.where("false")).where("predicted = 1").count() == 0


def test_exceptions_spare_matches():
    lexicon = toxicity.Lexicon({" trash ": 2.0}, exceptions=("trash can",))
    assert lexicon.mass("a trash can here")[0] == 0 and lexicon.mass("trash, trash can")[0] == 2.0


def test_quality_model(spark):
    good = [prose(k, 80) for k in range(150)]
    bad = ["$$$ ".join(prose(k + 500, 80).split()) for k in range(150)]
    texts = list(enumerate(good + bad))
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k, _ in texts], "doc_id long, quality int, toxic int")
    got = quality_model.op8_quality_model(documents(spark, [*texts, (7000, None), (7001, ""), (7002, "x" * 100_000)]), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got) and sum(r["predicted"] == int(r["doc_id"] < 150) for r in held) >= 0.95 * len(held)
    assert quality_model.op8_quality_model(empty(spark), labels).count() == 0
    assert {r["score"] for r in quality_model.op8_quality_model(documents(spark, [(1, "a")]), labels.where("false")).collect()} == {0.5}


def test_scores_by_hand():
    """The additive model against a sum of table entries, and the lexicon against a plain search of its terms."""
    r = np.random.default_rng(4)
    x = r.random((400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=400) * 0.2 > 0.8).astype(float)
    model = quality_model.fit(x, y, (4000, 100))
    for row, score in zip(x[:40], model.score(x[:40]), strict=True):
        total = model.bias + sum(t[sum(e <= v for e in edge)] for v, edge, t in zip(row, model.edges, model.tables, strict=True))
        total += sum(t[sum(e <= row[i] for e in model.coarse[i])][sum(e <= row[j] for e in model.coarse[j])] for (i, j), t in model.pairs.items())
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert math.isclose(model.bias, math.log(100 / 4000))
    lexicon = toxicity.Lexicon({" idiot ": 2.0, " stup": 1.5, " stupid ": 1.0}, bias=-1.0, slope=1.5, drag=0.3, exceptions=("stupid joke",))
    words = "a 1d10t told one stupid joke to a Stupid, stupendous idiot".split()
    total = 2.0 + 1.5 + 1.5 + 2.0  # the heaviest of what begins at a place; the joke is spared
    assert math.isclose(lexicon.score(" ".join(words)), 1 / (1 + math.exp(-(-1.0 + 1.5 * math.log1p(total) - 0.3 * math.log1p(len(words))))))


def test_rates_do_not_follow_the_sample(spark):
    """A sample of equal classes out of unequal ones gives scores at the true rate."""
    texts = [(k, ("good " if k % 10 else "nasty ") + prose(k, 30)) for k in range(1500)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k, _ in texts], "doc_id long, quality int, toxic int")
    for most in (100, 10_000):
        sample = toxicity.labelled_sample(docs.unionAll(docs), labels, "toxic", F.lit(False), most)
        assert sample.totals == (1350, 150) and len(sample.rows) == min(most, 1500) if most > 1500 else len(sample.rows) == 100
        blank = toxicity.fitted(toxicity.Lexicon({}), sample.rows, sample.weights())
        assert abs(blank.score("anything") - 0.1) < 0.01
    small = toxicity.labelled_sample(docs, labels, "toxic", F.lit(False), 10_000, 20_000)
    assert sum(len(t.encode()) for t, _ in small.rows) <= 20_000 and small.totals == (1350, 150)


def test_held_out_labels(spark):
    """On the labelled rows that training must not read."""
    from sparkloom.llm import queries as q

    data = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for name, label, least in (("op7_toxicity", "toxic", 0.98), ("op8_quality_model", "quality", 0.98)):
        rows = [r for r in q.queries()[name](spark, data).where("held_out").collect() if r["doc_id"] in labels]
        assert len(rows) > 500 and np.mean([r["predicted"] == labels[r["doc_id"]][label] for r in rows]) >= least


def test_language_fusion_by_hand(spark):
    """Posteriors from the formula: tempered likelihoods, host priors down the levels, and weights of declarations."""
    langs = {"aa": "ka lo mi tu".split(), "bb": "strz gry plch wnt".split(), "cc": "ka gry lo wnt".split()}
    r = random.Random(5)
    word = lambda g: "".join(r.choice(langs[g]) for _ in range(2))
    train = [(" ".join(word(g) for _ in range(20)), g) for g in langs for _ in range(30)]
    model = language_id.train(train)
    rows = []
    for k in range(60):
        g = r.choice(list(langs))
        rows.append((k, " ".join(word(g) for _ in range(r.randrange(1, 4))), r.choice([g, g, "bb", "zz", None]), f"d{k % 2}", f"d{k % 2}.h{k % 5}" if k % 7 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, said string, domain string, host string")
    evidence = language_id.Evidence(F.col("said"), None, (F.col("domain"), F.col("host")))
    got = {x["doc_id"]: x for x in language_id.identified(df, model, evidence, ["doc_id"]).select("_row.doc_id", "language", "posterior").collect()}
    ll = {k: model.likelihoods(*byte_view(pa.array([t])))[0] * language_id.TEMPER for k, t, *_ in rows}
    top = {k: int(v.argmax()) if v[-1] < 0 else -1 for k, v in ll.items()}
    names, n = model.languages, len(model.languages) + 1
    count = lambda ks: np.bincount([top[k] for k in ks if top[k] >= 0], minlength=n)
    base = (count(top) + 1.0) / (count(top) + 1.0).sum()
    base[-1] = language_id.UNKNOWN
    base /= base.sum()
    prior = {}
    hosted = [x for x in rows if x[4]]
    for domain in {x[3] for x in hosted}:
        c = count([x[0] for x in hosted if x[3] == domain])
        above = (c + language_id.STRENGTH * base) / (c.sum() + language_id.STRENGTH)
        for host in {x[4] for x in hosted if x[3] == domain}:
            c = count([x[0] for x in hosted if x[4] == host])
            prior[host] = (c + language_id.STRENGTH * above) / (c.sum() + language_id.STRENGTH)
    told = [x for x in rows if top[x[0]] >= 0 and x[2] in names]
    right = min(max((sum(top[x[0]] < len(names) and names[top[x[0]]] == x[2] for x in told) + 1) / (len(told) + 2), 0.01), 0.99)
    for k, _, said, _, host in rows:
        score = ll[k] + np.log(prior.get(host, base))
        if said in names:
            score = score + np.log([*(right if x == said else (1 - right) / (n - 2) for x in names), 1 / (n - 1)])
        best = int(score.argmax())
        assert got[k]["language"] == ([*names, None][best]) and math.isclose(got[k]["posterior"], 1 / np.exp(score - score.max()).sum(), rel_tol=1e-6)


def test_many_languages_are_all_trained(spark):
    rows = [(f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} word{j}", f"l{k:03}") for k in range(80) for j in range(3)]
    df = spark.createDataFrame([*rows, *rows], "text string, lang string")
    got = language_id.labelled_texts(df)
    assert sorted(got) == sorted(rows)


def test_pair_interactions():
    r = np.random.default_rng(0)
    x = np.column_stack([r.random((2000, 2)), np.zeros((2000, 1))])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9 and (1, 0) in model.pairs


def test_language(spark, odd):
    r = random.Random(0)
    langs = {"aa": "ka lo mi tu".split(), "bb": "strz gry plch wnt".split()}
    rows = [(k, " ".join("".join(r.choice(langs[g]) for _ in range(3)) for _ in range(12)), g, "h" + g, 1) for k, g in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows + [(900, "???", "aa", None, 1), (901, None, None, None, 1), (902, "ka", None, "haa", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("language", F.lit("clash"))
    got = {x["doc_id"]: x for x in language_id.op3_language_id(df).collect()}
    assert all(got[k]["language"] == g and got[k]["kept"] for k, _, g, _, _ in rows)
    assert not got[900]["kept"] and not got[901]["kept"] and got[902]["language"] == "aa"
    kept = language_id.kept_documents(df.drop("language"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 121
    assert language_id.op3_language_id(empty(spark)).count() == 0
    pages = spark.createDataFrame([(1, "http://x.example.bb/aa/1", "<html lang='aa'><p>kaloka mitulo</p></html>"), (2, None, None)], "page_id long, url string, html string")
    out = {x["page_id"]: x for x in language_id.identified_pages(pages, df.drop("language")).collect()}
    assert out[1]["language"] == "aa" and not out[2]["kept"]


def test_quality_rules(spark, odd):
    import duckdb

    df = documents(spark, odd)
    got = sorted((tuple(r) for r in quality_rules.op5_quality_rules(df).collect()), key=str)
    documents_arrow = pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("ka", pa.string()), ("seq", pa.string())]))
    con = duckdb.connect()
    con.register("documents", documents_arrow)
    assert got == sorted(con.sql(quality_rules.op5_sql()).fetchall(), key=str)
    kept = quality_rules.kept_documents(df)
    assert kept.columns == df.columns and kept.where("doc_id in (4, 5, 6, 7, 8, 12)").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert quality_rules.op5_quality_rules(empty(spark)).count() == 0


def test_failing_host_takes_its_documents_along(spark):
    rows = [(k, prose(k, 80), "en", "good", 1) for k in range(40)] + [(100 + k, "short" if k else prose(999, 80), "en", "bad", 1) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in quality_rules.op5_quality_rules(df).collect()}
    assert got[1]["kept"] and not got[100]["base_failed"] and not got[100]["kept"]


def test_texts_that_share_a_passage_are_no_candidates(spark):
    """Long texts share some n-grams by chance; what is sent on must not grow with the pairs that do."""
    from sparkloom.llm.shared import staging

    rows = [(d, " ".join([f"w{d}x{k}" for k in range(2400)] + [f"p{d // 2}x{k}" for k in range(60)])) for d in range(12)]
    with staging() as paths:
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(d, d) for d in range(12)]
    assert spark.read.parquet(next(p for p in paths if "/prefixes-" in p)).count() == 0


@pytest.mark.parametrize("share", [2, 0.05])
def test_join_in_rounds(spark, monkeypatch, share):
    """Chains in which only neighbours are alike, over any number of rounds."""
    monkeypatch.setattr(jaccard_join, "ROUND", share)
    rows = [(100 * c + d, " ".join(f"c{c}w{k}" for k in range(d * 20, d * 20 + 300))) for c in range(3) for d in range(14)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.op10_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 100 for d, _ in rows}


def test_few_meetings_at_once(spark, monkeypatch):
    """Pairs of cells are found in rounds of bounded size, with lists of several chunks: one round's pairs and all of them are the same."""
    rows = [(token, cell, 2 * cell, 60, at) for token in range(5) for at, cell in enumerate(range(token, 40, 1 + token))]
    entries = spark.createDataFrame([r for t in range(8) for r in [(8 * x[0] + t, *x[1:]) for x in rows]], "token long, cell long, comp long, n long, at long").withColumn("at", F.lit(0))
    placed = spark.createDataFrame([(60,)] * 40, "n long")
    whole = sorted(tuple(x) for x in jaccard_join._pairs_in_rounds(entries, placed, 40, 80).collect())
    sizes, find = [], jaccard_join._cell_pairs

    def seen(*args):
        sizes.append(find(*args).count())
        return find(*args)

    monkeypatch.setattr(jaccard_join, "_cell_pairs", seen)
    monkeypatch.setattr(jaccard_join, "FEW_MEETINGS", 1000)
    monkeypatch.setattr(jaccard_join, "MEETINGS", 0)
    for cells in (256, 7):
        sizes.clear()
        monkeypatch.setattr(jaccard_join, "LIST", cells)
        assert sorted(tuple(x) for x in jaccard_join._pairs_in_rounds(entries, placed, 40, 80).collect()) == whole
        assert len(whole) == 40 * 39 // 2
        assert len(sizes) > 5
        assert max(sizes) < len(whole) / 2


def test_common_n_grams_stand_out_from_many(spark):
    """An n-gram of 150 texts among a million others is common; in 2**17 bins it was not told from chance in a larger corpus."""
    r = random.Random(5)
    texts = [("one common passage here " if k % 4 == 0 else "") + " ".join(f"w{r.randrange(10**9)}" for _ in range(1700)) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, _t string").select("doc_id", "_t", *jaccard_join._key())
    classes = jaccard_join._classes(jaccard_join._facts(docs, 4).cache())
    common = [sets for _, _, sets, _ in shingle_sets(*byte_view(pa.array(["one common passage here"])), 4)][0]
    assert len(classes) == 1 << jaccard_join.BIN_BITS
    assert classes[jaccard_join._bins(common)] >= 7
    assert (classes > 0).mean() < 0.0001
