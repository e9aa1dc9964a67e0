"""Operators that compare documents with each other or with other tables."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA, ODD, prose
from tidemark.llm import bcr, chat, decontaminate, graph, jvm, lm, near, repeats, shard

# -- components


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_join_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 10)
    rows = [(k, i) for k, n in ((1, 300), (2, 11), (3, 10), (4, 1)) for i in range(n)] + [(None, 7), (5, 7)]
    left = spark.createDataFrame(rows, "k long, `__hot0` long").withColumn("a.b", F.lit("x"))
    keyed = spark.createDataFrame([(1, 300, "a"), (2, 11, "b"), (3, 10, "c"), (4, 1, "d"), (9, 0, "z")], "k long, n long, v string")
    got = graph.join_apart(left, keyed, "k", "n", len(rows))
    assert got.columns == ["k", "__hot0", "a.b", "v"]
    assert Counter(map(tuple, got.collect())) == Counter((k, i, "x", "abcd"[k - 1]) for k, i in rows if k in (1, 2, 3, 4))


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 10)
    edges = [(0, i) for i in range(1, 80)] + [(200, i) for i in range(201, 260)] + [(259, 300), (300, 301)] + [(500 + i, 499) for i in range(1, 30)] + [(499, 79)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 200 if 200 <= x <= 301 else 0 for e in edges for x in e}


# -- n-gram join


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        out.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def brute_classes(rows, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = sets_of(texts)
    links, parent = defaultdict(set), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                links[i].add(j)
                links[j].add(i)
                parent[max(find(i), find(j))] = min(find(i), find(j))
    at = {t: i for i, t in enumerate(texts)}
    ids = defaultdict(list)
    for d, t in rows:
        if d is not None:
            ids[find(at[t or ""])].append(d)
    return [(d, min(ids[find(at[t or ""])], default=None), len(links[at[t or ""]])) for d, t in rows]


def edited(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def corpus():
    rows = [(i, prose(i, 40 + i)) for i in range(30)]
    rows += [(100 + i, edited(prose(3, 120), i, 1)) for i in range(40)] + [(200 + i, prose(5, 45)) for i in range(5)] + [(300 + i, edited(prose(7, 60), i, i)) for i in range(9)]
    return rows + [(400, prose(3, 120).upper()), *[(None if d is None else 500 + d, t) for d, t in ODD]]


def result(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_near_against_brute_force(docs_of):
    rows = corpus()
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in near.classes(docs_of(rows).withColumn("rep_id", F.lit("x"))).collect()]
    assert result(got) == result(brute_classes(rows))


def test_near_large_groups_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_DOCS", 7)
    monkeypatch.setattr(graph, "HOT", 3)
    rows = corpus()
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in near.classes(docs_of(rows)).collect()]
    assert result(got) == result(brute_classes(rows))


def test_near_one_of_each(docs_of):
    rows = corpus()
    docs = docs_of(rows)
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, c, _ in brute_classes(rows)}
    got = [r["doc_id"] for r in kept.collect()]
    assert Counter(got) == Counter(x for x in want)
    assert near.one_of_each(docs_of([])).count() == 0


def test_bands_reach_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = near.bands_for(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= 128
    with pytest.raises(ValueError):
        near.bands_for(0.01, 0.999999)


# -- decontamination


def test_leaks(spark, docs_of):
    item, other = prose(50, 40), prose(51, 9)
    bench = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None), (None, item)], "item_id long, text string")
    swapped = item.split()
    for k in (5, 13, 22, 31):
        swapped[k] = "zzz"
    rows = [(10, prose(1, 50) + " " + item + " " + prose(2, 50)), (11, prose(3, 50) + " " + " ".join(swapped).upper()), (12, other + " end"), (13, prose(4, 200)), (14, "too short"), (15, " ".join(item.split()[:20])), (16, " ".join(item.split()[:8])), *ODD]
    got = {(r["doc_id"], i["item_id"]): (i["equal_words"], i["stretch_words"]) for r in decontaminate.with_leaks(docs_of(rows), bench).collect() for i in r["leaks"]}
    assert got == {(d, i): v for d, v in {10: (40, 40), 11: (36, 40), 15: (20, 20)}.items() for i in (1, None)} | {(12, 2): (9, 9)}
    docs = docs_of(rows).withColumn("leaks", F.lit("own"))
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 4
    assert decontaminate.with_leaks(docs_of([]), bench).count() == 0
    assert decontaminate.clean(docs_of(rows), bench.limit(0)).count() == len(rows)


def test_every_planted_item_is_found(spark, small):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op7_decontamination(spark, DATA).collect()}
    cut = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))) + " "
    items = [(r["item_id"], cut(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in small.collect() for i, t in items if t in cut(r["text"]) and t.count(" ") > decontaminate.SHORTEST}
    assert want and want <= got


def planted(item, places, seed):
    words = [w if k not in places else f"zzz{k}" for k, w in enumerate(item.split())]
    return " ".join([prose(seed, 20), *words, prose(seed + 1, 20)]).encode()


def leaks_of(spark, docs_of, items, texts):
    """By text: (item, equal words, words of the stretch, first word)."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.with_leaks(docs_of([(i, t.decode()) for i, t in enumerate(texts)]), bench).select("doc_id", "leaks").collect()
    return [[(x["item_id"], x["equal_words"], x["stretch_words"], x["start_word"]) for x in r["leaks"]] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_leaks_of_whole_items_by_share(spark, docs_of):
    """Few substitutions in a short item leave no stretch of LEAST equal words, but most of the item in place."""
    item = prose(80, 16)
    cases = [({1, 6, 11}, [(0, 13, 16, 20)]), ({2, 7, 12}, [(0, 13, 16, 20)]), ({0, 5}, [(0, 14, 15, 21)]), ({1, 3, 5, 7, 9, 11}, [])]
    assert leaks_of(spark, docs_of, [item], [planted(item, places, 81) for places, _ in cases]) == [want for _, want in cases]


def brute_leaks(items, text):
    """Items of which 2/3 of the words are in the text at one distance, or of which a stretch scores as the rule says."""
    words, out = text.decode().split(), set()
    for i, item in enumerate(t.split() for t in items):
        for s in range(-len(item), len(words)):
            equal = [a == b for a, b in zip(item[max(0, -s) :], words[max(0, s) :], strict=False)]
            if sum(equal) * 3 >= len(item) * 2:
                out.add(i)
            elif sum(equal) >= decontaminate.LEAST:
                best, here, same = (0, 0), 0, 0
                for e in equal:  # the best-scoring stretch, the shorter of equals
                    here, same = (0, 0) if here <= 0 else (here, same)
                    here, same = here + (1 if e else -2), same + e
                    best = max(best, (here, same), key=lambda x: x[0])
                if best[1] >= decontaminate.LEAST:
                    out.add(i)
    return out


def test_leaks_with_substitutions_against_brute_force(spark, docs_of):
    """Nothing but leaks is found, and every one of whole items."""
    rng = random.Random(12)
    items, texts = [prose(1000 + n, n) for n in range(12, 25)], []
    for t in items:
        n = t.count(" ") + 1
        texts += [planted(t, {k for k in range(n) if rng.random() < rate}, rng.randrange(10**6)) for rate in (0.1, 0.2, 0.3) for _ in range(12)]
        texts += [planted(t, set(range(first, n, step)), 7) for step in (3, 4) for first in range(step)]
    want = [brute_leaks(items, t) for t in texts]
    got = [{i for i, *_ in found} for found in leaks_of(spark, docs_of, items, texts)]
    assert sum(map(len, want)) > 300
    assert got == want


def test_leaks_of_short_items(spark, docs_of):
    """Items below 12 words are found with changed words; two of eight, three of nine to eleven."""
    sizes = range(decontaminate.SHORTEST, 12)
    items, texts, want = [prose(2000 + n, n) for n in sizes], [], []
    for i, n in enumerate(sizes):
        for places in itertools.combinations(range(n), n // 3):
            texts.append(planted(items[i], set(places), 9))
            want.append([i])
        texts.append(planted(items[i], set(range(n // 3 + 1)), 9))
        want.append([])
    assert [[i for i, *_ in found] for found in leaks_of(spark, docs_of, items, texts)] == want


def test_leaks_query(spark, small):
    """The query on the smallest tables, against every shift of every item over every text."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r["item_id"]: cut(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["equal_words"] for r in decontaminate.op7_decontamination(spark, DATA).collect()}
    want = {}
    for r in small.collect():
        words = cut(r["text"])
        at = defaultdict(list)
        for k, w in enumerate(words):
            at[w].append(k)
        for i, item in items.items():
            lines = Counter(k - j for j, w in enumerate(item) for k in at.get(w, ()))
            top = max(lines.values(), default=0)
            if len(item) >= decontaminate.SHORTEST and top * 3 >= len(item) * 2:
                want[r["doc_id"], i] = top
    assert want and want.items() <= got.items()
    assert all(v >= decontaminate.LEAST for k, v in got.items() if k not in want)


def test_masks_cover_all_choices_of_equal_words():
    for n, equal in ((9, 6), (12, 8)):
        for places in itertools.combinations(range(n), equal):
            assert any(all(a + k in places for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for a in range(n - len(m) + 1))


# -- repeated passages


def brute_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        own = [b[s : s + 100] for s in range(len(b) - 99)]
        for s, w in enumerate(own):
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def passages():
    common = prose(70, 60)
    rows = [(i, prose(i, 30) + " " + common + " " + prose(i + 500, 20)) for i in range(25)] + [(50 + i, edited(prose(80, 150), i, 2)) for i in range(20)]
    rows += [(80, "ab" * 400), (81, "x" * 99), (82, "x" * 100), (83, "x" * 101), (84, prose(80, 150)), (85, prose(80, 150)), (86, "é" * 120), (87, common[:99]), (88, common[:100]), (90, ""), (91, None)]
    return rows


def test_repeats_against_brute_force(docs_of):
    rows = passages()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(docs_of(rows)).collect()}
    assert got == brute_repeats(rows)


def test_repeats_hot_grams_and_pieces(docs_of, monkeypatch):
    # Limits so low that every path is taken; tasks see them by closure only in this process, so they are applied by hand.
    rows = passages()
    assert [p[2] for p in repeats.pieces_of(1, 0, b"x" * (repeats.PIECE + 50))] == [0]
    assert [p[2] for p in repeats.pieces_of(1, 0, b"x" * (repeats.PIECE + 500))] == [0, repeats.PIECE]
    monkeypatch.setattr(repeats, "HOT", 3)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs_of(rows)).collect()}
    assert got == {d: v[1] for d, v in brute_repeats(rows).items()}


def test_repeats_odd_rows(docs_of):
    rows = [*ODD, (60, prose(1, 40)), (60, prose(1, 40)), (None, prose(1, 40))]
    got = repeats.remove_repeats(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert [r["n_removed"] for r in got if r["doc_id"] == 60] == [0, 0]
    assert max(r["n_removed"] for r in got if r["doc_id"] is None) == len(prose(1, 40))
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_repeats_of_ids_with_several_texts(docs_of):
    long, short = prose(3, 60), prose(4, 3)
    rows = [(0, long), (1, long), (1, short), (1, prose(5, 40)), (1, prose(5, 40)), (2, prose(5, 40)), (None, long), (None, short)]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.remove_repeats(docs_of(rows)).collect()}
    n, m = len(long), len(prose(5, 40))
    assert got == {(0, n): 0, (1, n): n, (1, len(short)): 0, (1, m): 0, (2, m): m, (None, n): n, (None, len(short)): 0}


def test_repeats_query(spark, small):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.op5_suffix_array_dedup(spark, DATA).collect()}
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in small.collect()])


def test_column_wise_construction():
    rng = random.Random(3)
    for _ in range(150):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        cap = rng.choice([3, 5, 100])
        bwt, lcp = bcr.construct(strings, cap)
        string, size, row = bcr.rows_of(bwt, np.array([len(s) for s in strings]), 1)
        at = {r: strings[j][len(strings[j]) - n :] for j, n, r in zip(string, size, row, strict=True)}
        suffixes = [at.get(r, b"") for r in range(len(bwt))]
        assert suffixes == sorted(suffixes)
        assert [int(x) for x in lcp[1:]] == [min(cap, len(os.path.commonprefix([a, b]))) for a, b in zip(suffixes[:-1], suffixes[1:], strict=True)]


# -- sharding


def test_shards(docs_of):
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randint(5, 60))) for i in range(400)] + [(500 + i, prose(999, 20)) for i in range(60)] + [(700 + i, prose(998, 3)) for i in range(100)] + ODD
    out = shard.shards(docs_of(rows), 8).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(8))
    bytes_ = out.groupby("shard")["size"].sum()
    assert bytes_.max() / bytes_.min() < 1.06 + 5100 / bytes_.min()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (out.groupby(["text_crc32", "size"])["shard"].nunique() == 1).all()
    assert dict(zip(out["doc_id"], out["text_crc32"], strict=True))[3] == zlib.crc32(b"   \n\t ")


def test_shards_split_a_text_above_a_shard(docs_of):
    rows = [(i, prose(999, 20)) for i in range(300)] + [(1000 + i, prose(i, 20)) for i in range(300)]
    out = shard.shards(docs_of(rows), 8).toPandas()
    bytes_ = out.groupby("shard")["size"].sum()
    assert len(bytes_) == 8 and bytes_.max() / bytes_.min() < 1.15
    assert len(out) == 600 and (out.groupby("shard")["slot"].max() + 1 == out.groupby("shard").size()).all()


def test_shards_by_target_and_empty(docs_of):
    rows = [(i, prose(i, 30)) for i in range(64)]
    total = sum(len(t) + 1 for _, t in rows)
    out = shard.shards(docs_of(rows), target_bytes=total // 5 + 1).toPandas()
    assert out["shard"].nunique() == 5
    assert shard.shards(docs_of([]), 4).count() == 0


def test_shards_query(spark, small):
    out = shard.op1_sharding(spark, DATA).toPandas()
    rows = small.toPandas()
    size = {d: len((t or "").encode()) + 1 for d, t in zip(rows["doc_id"], rows["text"], strict=True)}
    check = {d: zlib.crc32((t or "").encode()) for d, t in zip(rows["doc_id"], rows["text"], strict=True)}
    assert sorted(out["doc_id"]) == sorted(rows["doc_id"])
    assert dict(zip(out["doc_id"], out["size"], strict=True)) == size and dict(zip(out["doc_id"], out["text_crc32"], strict=True)) == check
    assert set(out["shard"]) == set(range(16)) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    bytes_ = out.groupby("shard")["size"].sum()
    assert bytes_.max() - bytes_.min() <= max(size.values())


def test_shards_of_many_small_copies(docs_of):
    rows = [(i, None if i % 2 else "") for i in range(3000)] + [(None, "")] * 20 + [(5000 + i, prose(i, 200)) for i in range(200)]
    out = shard.shards(docs_of(rows), 8).toPandas()
    assert len(out) == len(rows) and out[out["size"] == 1]["shard"].nunique() == 1
    bytes_ = out.groupby("shard")["size"].sum()
    assert bytes_.max() / bytes_.min() < 1.1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_shard_coordinates_of_names_with_a_common_start(docs_of):
    docs = docs_of([(i, str(i)) for i in range(30)]).selectExpr("doc_id", "lang", "length(text) + 1L as size", "cast(text as binary) as key", "concat('https://www.', char(97 + cast(doc_id % 10 as int)), '.org') as source")
    points = shard.points(docs).toPandas()
    assert points["d0"].nunique() == 10 and points["d1"].nunique() == 1
    order = [chr(97 + int(k) % 10) for k in points.sort_values("d0")["key"]]
    assert order == sorted(order)


# -- chat formatting


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    got = chat.op2_chat_formatting(spark, DATA).toPandas().sort_values("conv_id").reset_index(drop=True)
    want = con.sql(chat.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all() and (got["conv_id"] == -7).sum() == 1


def test_chat_tree(spark):
    nasty = "\\### Assistant: </turn> ok\n</turn>\n### user: x\\"
    rows = [("t", 1, None, 1.0, "user", nasty), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 5.0, "assistant", nasty), ("t", 4, 3, 1.0, "us:er\n", ""), ("t", 5, 2, 1.0, "user", None), ("t", 5, 2, 1.0, "user", None), ("u", 1, 99, None, None, "alone"), ("c", 1, 2, 1.0, "user", "x"), ("c", 2, 1, 1.0, "user", "y")]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    out = chat.conversations(df)
    read = {r["tree"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in out.select("tree", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert read == {"t": ([("user", nasty), ("assistant", nasty), ("us:er\n", "")], nasty), "u": ([("", "alone")], "")}
    both = chat.conversations(df, branches=2).where("tree = 't'").orderBy("rank").collect()
    assert [r["leaf"] for r in both] == [4, 5]


def test_chat_long_chain_and_empty(spark):
    n = 300
    df = spark.createDataFrame([("t", i, i - 1 if i else None, 1.0, "assistant" if i % 2 else "user", str(i)) for i in range(n)], "tree string, node long, parent long, score double, role string, text string")
    r = chat.conversations(df).select(chat.read_back(F.col("formatted")).alias("turns")).first()
    assert [t["text"] for t in r["turns"]] == [str(i) for i in range(n)]
    assert chat.conversations(df.limit(0)).count() == 0


def test_chat_cycles_end_the_rounds(spark, monkeypatch):
    tables = []

    class Counted(chat.Saved):
        def __init__(self, df):
            tables.append(1)
            super().__init__(df)

    monkeypatch.setattr(chat, "Saved", Counted)
    rows = [("t", 1, 2), ("t", 2, 1), ("t", 3, 2), ("t", 4, 4), ("t", 5, None), ("t", 6, 5), ("t", 7, 6)]
    df = spark.createDataFrame([(t, n, p, 1.0, "assistant", str(n)) for t, n, p in rows], "tree string, node long, parent long, score double, role string, text string")
    r = chat.conversations(df, branches=5).collect()
    assert [(x["leaf"], x["formatted"].count("</turn>")) for x in r] == [(7, 3)] and len(tables) < 12
    assert [r[0]["formatted"][s["start"] : s["end"]] for s in r[0]["loss_spans"]] == ["5", "6", "7"]


# -- language model


def brute_base_scores(rows):
    words = [[w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["<end> "] for _, t in rows]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws, h in zip(rows, words, held, strict=True)]


def test_lm_base_scores(docs_of, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choice(["the", "of", "Cat", "dog", "ran"]) for _ in range(i % 40))) for i in range(200)] + ODD
    got = [tuple(r)[:6] for r in lm.score(docs_of(rows)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(brute_base_scores(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert lm.score(docs_of([])).count() == 0


def lm_model(size, seed):
    rng = np.random.default_rng(seed)
    codes = lm.Codes(rng.integers(0, 50, size + 1))
    vectors, nodes = codes.start()
    return lm.Attention(codes, None, vectors + rng.normal(0, 0.3, vectors.shape).astype(np.float32), nodes + rng.normal(0, 0.3, nodes.shape).astype(np.float32))


def lm_step(rng, n=5):
    return rng.integers(0, 300, (n + 1, lm.HALF)), rng.random(n) < 0.3, rng.integers(0, 301, (n, lm.HALF)), rng.random((n, lm.HALF)) < 0.8


def test_lm_gradients():
    rng, model = np.random.default_rng(3), lm_model(300, 3)
    step = lm_step(rng)
    _, flat, vectors, nodes = model.gradients(*step)
    assert nodes[2].sum() == model.codes.length(step[2][step[3]]).sum()

    def slope(table, at):
        loss = []
        for by in (1e-2, -1e-2):
            other = lm.Attention(model.codes, model.flat, model.vectors, model.nodes)
            getattr(other, table)[at] += np.float32(by)
            loss.append(other.gradients(*step)[0])
        return (loss[0] - loss[1]) / 2e-2

    for i in rng.permutation(len(flat))[:40]:
        assert slope("flat", i) == pytest.approx(flat[i], rel=0.05, abs=3e-4)
    for table, (rows, g, often) in (("vectors", vectors), ("nodes", nodes)):
        assert len(set(rows)) == len(rows) == len(often)
        for k in rng.permutation(len(rows))[:12]:
            for j in (0, 7, g.shape[1] - 1):
                assert slope(table, (rows[k], j)) == pytest.approx(g[k, j], rel=0.05, abs=3e-4)


def test_lm_looks_back_only_and_not_into_other_documents():
    rng, model = np.random.default_rng(2), lm_model(300, 2)
    seen, fresh, target, _ = lm_step(rng, 3)
    fresh[:] = [False, False, True]
    p = model.log_probability(seen, fresh, target).reshape(3, lm.HALF)
    later, before = seen.copy(), seen.copy()
    later[2, 10:] = (later[2, 10:] + 1) % 300
    before[0] = (before[0] + 1) % 300
    q, r = (model.log_probability(x, fresh, target).reshape(3, lm.HALF) for x in (later, before))
    assert np.allclose(p[0], q[0], atol=1e-5) and np.allclose(p[1, :10], q[1, :10], atol=1e-5) and not np.allclose(p[1, 10:], q[1, 10:], atol=1e-3)
    assert np.allclose(p[2], q[2], atol=1e-5)  # begins a document
    assert not np.allclose(p[0], r[0], atol=1e-3) and np.allclose(p[1:], r[1:], atol=1e-5)


def test_lm_half_windows_score_each_token_once():
    for sizes in ([1], [16], [17], [28], [29, 1, 100, 5]):
        first, ids = np.cumsum([0, *sizes])[:-1], np.arange(sum(sizes))
        for step in (1, 2, 100):
            halves, hits = lm.Halves(ids, first, 999), Counter()
            for k in range(0, len(halves.start), step):
                seen, fresh, target, live, at = halves.step(k, k + step)
                hits.update(target[live].tolist())
                assert (seen[1:][live] == np.where(np.isin(target, first), 999, target - 1)[live]).all()
                # a half window that begins no document has the whole one before it in view
                place = at[:, :1] - lm.HALF + np.arange(lm.HALF)
                assert (seen[:-1][~fresh] == np.where(np.isin(place, first), 999, place - 1)[~fresh]).all()
            assert hits == Counter(ids.tolist())


def test_lm_steps_of_scoring_are_large_and_do_not_count(monkeypatch):
    rng, model, calls, whole = np.random.default_rng(4), lm_model(300, 4), [], lm.Attention.log_probability
    row = lm_row([rng.integers(0, 300, n) for n in (5, 3000, 17, 9000)])
    want = lm.score_block(model, row, 7)
    monkeypatch.setattr(lm.Attention, "log_probability", lambda self, *a: calls.append(1) or whole(self, *a))
    assert lm.score_block(model, row) == pytest.approx(want, rel=1e-6) and len(calls) == 1


def test_lm_cuts_what_exponentials_cannot_take():
    z = np.array([[-500, -60, 0.5, 60, 500]], np.float32)
    assert lm._bounded(z) is z and z.tolist() == [[-60, -60, 0.5, 60, 60]]
    x = np.random.default_rng(5).random((5 * lm.HALF, lm.DIM)).astype(np.float32)
    assert (lm._turned(x) == lm._windows(x).transpose(0, 2, 1)).all() and lm._turned(x).flags.c_contiguous


def test_lm_scores_do_not_follow_the_layout(docs_of):
    rows = [(i, prose(i % 90, 40 + i % 50)) for i in range(150)] + ODD
    a, b, c = (sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in lm.score(docs).collect()) for docs in (docs_of(rows).coalesce(1), docs_of(rows).repartition(5), docs_of(rows[::-1]).coalesce(3)))
    assert a == b == c


def test_lm_rows_repeated_many_times(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "REPEATS", 5)
    rows = [(i, prose(i, 30)) for i in range(20)] + [(7, prose(7, 30))] * 30 + [(None, "a b")] * 9
    got = Counter((r["doc_id"], r["n_tokens"], round(r["base_score"], 6)) for r in lm.score(docs_of(rows)).collect())
    assert got == Counter((d, n, round(s, 6)) for d, _, n, _, _, s in brute_base_scores(rows))


def test_lm_learns_order(docs_of):
    """Held-out texts in the order of training are likelier than the same words shuffled."""
    cycle = "red green blue cyan pink gold grey teal".split()
    rows = [(i, " ".join(cycle[(i + k) % 8] for k in range(120))) for i in range(300)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2][:10]
    mixed = [(10_000 + k, " ".join(random.Random(k).sample(dict(rows)[k].split(), 120))) for k in held]
    got = {r["doc_id"]: r["score"] for r in lm.score(docs_of(rows + [m for m in mixed])).collect()}
    assert np.mean([got[k] - got[10_000 + k] for k in held]) > 5


def test_lm_probabilities_of_all_ids_add_up():
    rng, model = np.random.default_rng(4), lm_model(500, 4)
    seen, fresh, _, _ = lm_step(rng, 1)
    h = np.repeat(model.hidden(seen, fresh)[0][9:10], 501, axis=0)
    p = np.exp(model.classes(h, model.codes.which)[0] + model.inside(h, np.arange(501))[0])
    assert p.sum() == pytest.approx(1, abs=1e-4)


def lm_row(docs):
    """Block of training documents given as subword ids."""
    n = np.array([len(d) for d in docs], np.int32)
    return {"block": 1, "n": n.tobytes(), "tokens": np.concatenate(docs).astype(np.int32).tobytes(), "subs": np.arange(300).astype(np.uint16).tobytes(), "sub_n": np.ones(300, np.int32).tobytes(), "train": np.ones(len(n), bool).tobytes()}


def test_lm_tells_ids_of_one_class_apart():
    """Of texts with the same sequence of classes and the same shares, the one whose words follow each other as in training is likelier."""
    rng = np.random.default_rng(6)
    codes = lm.Codes(np.full(301, 100))
    follows = rng.permutation(300)
    text = lambda: np.stack([x := rng.integers(0, 300, 100), follows[x]], axis=1).ravel()
    row, model = lm_row([text() for _ in range(400)]), lm.Attention(codes)
    steps = lm.Steps(model)
    for number in range(4 * lm.ROUNDS):
        lm.train_block(steps, row, number % lm.ROUNDS, 0.02)
    good = [text() for _ in range(20)]
    bad = [np.where(np.arange(200) % 2, [rng.choice(np.flatnonzero(codes.which[:-1] == codes.which[i])) for i in d], d) for d in good]
    assert all((codes.which[a] == codes.which[b]).all() for a, b in zip(good, bad, strict=True))
    assert (lm.score_block(model, lm_row(good)) - lm.score_block(model, lm_row(bad)) > 10).all()


def test_lm_rounds_train_on_every_token_once(monkeypatch):
    seen = Counter()

    def gradients(self, before, fresh, target, live):
        seen.update(target[live].tolist())
        none = lambda width: (np.zeros(0, np.int64), np.zeros((0, width), np.float32), np.zeros(0, np.float32))
        return 0.0, np.zeros_like(self.flat), none(lm.DIM), none(lm.DIM + 1)

    monkeypatch.setattr(lm.Attention, "gradients", gradients)
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 300, n) for n in (0, 1, 3, 15, 16, 17, 31, 100, 900, 2, 40, 600)]
    row, model = lm_row(docs), lm.Attention(lm.Codes(np.full(301, 100)))
    row["train"] = np.array([k != 8 for k in range(len(docs))]).tobytes()
    for turn in range(lm.ROUNDS):
        assert lm.train_block(lm.Steps(model), row, turn, 0.02)
    assert seen == Counter(np.concatenate([d for k, d in enumerate(docs) if k != 8]).tolist()) + Counter({300: len(docs) - 1})


def test_lm_blocks_are_trained_and_scored_in_the_jvm_as_in_numpy(spark):
    assert jvm.ready(spark)
    rng, codes = np.random.default_rng(9), lm.Codes(np.random.default_rng(9).integers(0, 50, 301))
    row = lm_row([rng.integers(0, 300, n) for n in (0, 1, 15, 16, 17, 40, 700, 3, 5000, 31)])
    row |= {"block": 5, "train": np.arange(10).astype(np.uint8) % 4 != 3}
    row["train"] = row["train"].tobytes()
    model = lm_model(300, 9)
    model = lm.Attention(codes, rng.normal(0, 0.5, len(model.flat)), model.vectors, rng.normal(0, 0.3, (len(codes.bias), lm.DIM + 1)).astype(np.float32))
    rows = lm._beside(spark.createDataFrame([(row["block"], *(bytearray(row[k]) for k in lm._SEQ))], "block long, n binary, tokens binary, subs binary, sub_n binary, train binary"), model)
    got = rows.select(F.call_udf(jvm.SCORE, *[F.col(c) for c in ("model", *lm._SEQ[:4])])).first()[0]
    assert np.frombuffer(got, "<f8") / math.log(10) == pytest.approx(lm.score_block(model, row), rel=1e-5)
    for turn in range(lm.ROUNDS):
        args = [F.col(c) for c in ("model", *lm._SEQ, "block")] + [F.lit(x) for x in (turn, lm.ROUNDS, lm.BATCH, 0.01, lm.ROW_RATE)]
        n, flat, tables = lm._read(rows.select(F.call_udf(jvm.TRAIN, *args)).first()[0])
        steps = lm.Steps(lm.Attention(codes, model.flat, model.vectors, model.nodes))
        assert n == lm.train_block(steps, row, turn, 0.01) > 1
        assert np.allclose(flat, steps.model.flat, atol=2e-3) and np.abs(flat - model.flat).max() > 0.02
        for mine, want in zip(tables, lm._met(steps, model), strict=True):
            assert mine[0].tolist() == want[0].tolist() and mine[1].tolist() == want[1].tolist()
            assert np.abs(want[2]).max() > 0.05 and np.allclose(mine[2], want[2], atol=0.02 * np.abs(want[2]).max())


def test_lm_without_a_compiler(docs_of, monkeypatch):
    docs = docs_of([(i, prose(i, 40)) for i in range(60)] + ODD)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"])
    a = sorted(lm.score(docs).collect(), key=key)
    monkeypatch.setattr(jvm, "ready", lambda spark: False)
    b = sorted(lm.score(docs).collect(), key=key)
    assert [tuple(r)[:6] for r in a] == [tuple(r)[:6] for r in b]
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b], rel=1e-3)


def test_lm_words_of_sliced_blocks(monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    with open(lm.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spaced = np.zeros(max(ranks.values()) + 1, bool)
    spaced[[r for t, r in ranks.items() if t[:1] == b" "]] = True
    texts = [(t or "").encode() for _, t in ODD] + [prose(i, 30).encode() for i in range(30)]
    ids = list(range(len(texts)))
    want = lm.make_block(ids, texts, enc, spaced)
    monkeypatch.setattr(lm, "SLICE_OF_TEXT", 100)
    assert lm.make_block(ids, texts, enc, spaced) == want


def test_lm_is_likelier_than_the_shares_of_subwords_on_held_out_texts(spark, small):
    got = {r["doc_id"]: r for r in lm.op9_lm_scoring(spark, DATA).where("held_out").collect()}
    table = lm.blocks(small, lm.default_path())
    counts = lm.subword_counts(table, 50256) + 1
    share, shares = np.log10(counts / counts.sum()), {}
    for r in table.collect():
        ids, doc, _ = lm.sequences(r.asDict(), np.zeros(len(counts), np.int64))
        shares |= dict(zip(r["doc_id"], np.bincount(doc, share[ids]), strict=True))
    assert len(got) > 10 and sum(r["score"] for r in got.values()) > 0.9 * sum(shares[d] for d in got)
    want = {(d, h, n, k, t, round(s, 6)) for d, h, n, k, t, s in brute_base_scores([(r["doc_id"], r["text"]) for r in small.collect()])}
    assert {(r["doc_id"], True, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.values()} == {w for w in want if w[1]}
