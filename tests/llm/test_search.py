"""Ranked search, sharding and phrases against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from teleproof.llm import collocations, lexical, sharding
from teleproof.llm.queries import QUERIES, TWINS

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_search", "op13_phrases"])
def test_against_sql(spark, sf, name):
    from compare import compare, connection

    assert compare(spark, connection(sf), name, QUERIES[name], TWINS[name], sf) == ""


# ---------------------------------------------------------------- search


def ranked(docs, items, most):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(d, split(t)) for d, t in docs]
    held = [(d, len(w), Counter(w)) for d, w in held if w]
    n_docs, n_terms = len(held), sum(n for _, n, _ in held)
    df = Counter(w for _, _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, n, c in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(split(text)) if c[w])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, frame, seed, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 40)
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Été", "ÉTÉ", "été", "x1\x00y", "straße"]
    text = lambda: " ".join(words[min(int(r.expovariate(0.12)), len(words) - 1)] for _ in range(r.randrange(1, 40)))
    docs = [(k, text()) for k in range(150)]
    docs += [(k, docs[3][1]) for k in range(200, 260)]  # many equal scores
    docs += [(None, docs[3][1]), (None, "W3-w7"), (1, docs[1][1]), (300, None), (301, ""), (302, "-- ?"), (303, "w5 " * 30_000)]
    items = [(k, text().upper()) for k in range(40)] + [(7, "w1"), (None, "w2 w3"), (50, ""), (51, None), (52, "unknown")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked_search(frame(docs, term="t", score="s").repartition(3), asked, most=5)
    found = sorted(map(tuple, got.collect()), key=repr)
    want = ranked(docs, items, 5)
    # Item 7 comes twice.
    assert found == want


def test_search_of_nothing(spark, frame):
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_search(frame([]), asked).collect() == []
    assert lexical.ranked_search(frame([(1, None), (2, "")]), asked).collect() == []
    assert lexical.ranked_search(frame([(1, "w1")]), asked.limit(0)).collect() == []


def test_range_maxima():
    r = np.random.default_rng(1)
    places = [np.sort(r.choice(500, n, replace=False)) for n in (1, 2, 37, 500)]
    lists = lexical.Lists(places, [r.integers(1, 50, len(p)) for p in places], 500)
    for t, base in enumerate(np.cumsum([0, *map(len, places)])[:-1]):
        for _ in range(200):
            a, b = base + np.sort(r.integers(0, len(places[t]) + 1, 2))
            value, at = lists.maxima(np.array([[a]]), np.array([[b]]))
            assert value[0, 0] == lists.impact[a:b].max(initial=0) and (a == b or a <= at[0, 0] < b)


# ---------------------------------------------------------------- sharding


def by_walking(rows, shards, points):
    """Every row by itself: in ring order, to the first shard clockwise that has room."""
    ring = sorted((int(hashlib.md5(f"{s}:{k}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for k in range(points))
    place = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    out = Counter()
    for text in sorted((t for _, t in rows), key=place):
        at = place(text)
        for s in [s for x, s in ring if x >= at] + [s for _, s in ring]:
            if room[s]:
                room[s] -= 1
                out[s, text] += 1
                break
    return out


@pytest.mark.parametrize("shards, n", [(1, 7), (3, 100), (5, 3), (16, 333)])
def test_shards(frame, shards, n):
    r = random.Random(n)
    rows = [(k if k % 9 else None, r.choice([None, "", "same", f"text {k}", "é" * k])) for k in range(n)] + [(1, "same")] * (n // 2)
    got = sharding.shard_rows(frame(rows, shard="a", slot="b", at="c").repartition(3), shards, points=8).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    want = Counter()
    for (s, text), k in by_walking(rows, shards, 8).items():
        want[s, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())] += k
    assert Counter((x.shard, x.size, x.text_crc32) for x in got) == want


def test_shards_move_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held, grown = ({x.doc_id: x.shard for x in sharding.shard_rows(docs, s).collect()} for s in (16, 17))
    elsewhere = sum(grown[d] not in (s, 16) for d, s in held.items())
    assert elsewhere < 0.1 * len(held)


def test_shards_of_nothing(frame):
    assert sharding.shard_rows(frame([])).collect() == []


# ---------------------------------------------------------------- phrases


def mined(rows, least, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    gone = {(g, p[i : i + k]) for (g, p), a in held.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[g, p[i : i + k]]}
    ranks = defaultdict(list)
    for (g, p), a in held.items():
        if (g, p) not in gone:
            score, k = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
            ranks[g].append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return sorted((g, k, p.decode(), -a, x, y, n[g], -s) for g, v in ranks.items() for k, (s, a, p, x, y) in enumerate(sorted(v)[:most], 1))


def phrase_rows(seed):
    r = random.Random(seed)
    words = ["new", "York", "city", "of", "É", "é", "a\x00", " ", "ß-1"] + [f"w{k}" for k in range(12)]
    rows = []
    for k in range(200):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n"]) for _ in range(r.randrange(60)))
        rows.append((r.choice(["en", "fr", None]), text + ("new york city of " * r.randrange(4))))
    rows += [("en", " ".join("x" * (60 + k % 9) + r.choice("ab") for k in range(40)))]
    return rows + [("xx", None), ("xx", ""), (None, " . "), ("fr", "la la " * 20_000)]


@pytest.mark.parametrize("seed", range(2))
def test_phrases(spark, seed):
    rows = phrase_rows(seed)
    docs = spark.createDataFrame([(k, g, t, "n") for k, (g, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(docs, least=5, most=40).collect())) == mined(rows, 5, 40)
    assert collocations.collocations(docs.limit(0)).collect() == []


def chunk_of(rows):
    chunk = collocations.Chunk()
    for lang, text in rows:
        chunk.add(lang or "und", (text or "").encode())
    chunk.close()
    return chunk


def word_lists(rows):
    """Words of all pieces of all documents in a row, with language and piece."""
    out, piece = [], 0
    for lang, text in rows:
        for part in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            piece += 1
            out += [(lang or "und", piece, w.encode()) for w in re.findall("[^ \t]+", part)]
    return out


@pytest.mark.parametrize("clash", [None, 7])
def test_words_of_a_chunk(monkeypatch, clash):
    """Words found as arrays, with good fingerprints and with seven values only."""
    monkeypatch.setattr(collocations, "SLICE_WORDS", 50)
    if clash:
        monkeypatch.setattr(collocations, "mixed", lambda x: x % np.uint64(clash))
    rows = phrase_rows(5)[:80] + [("fr", ""), ("en", None), ("en", "last word")]
    chunk, want = chunk_of(rows), word_lists(rows)
    chunk.number_words()
    names = chunk.texts_of(chunk.first, 1)
    assert [(chunk.lang_names[g], names[i]) for g, i in zip(chunk.lang, chunk.ids)] == [(g, w) for g, _, w in want]
    assert len(set(names)) == len(names)
    assert chunk.texts_of(np.array([3, 0]), 2) == [b" ".join(w for _, _, w in want[k : k + 2]) for k in (3, 0)]
    for size in (1, 2, 4):
        starts, _ = chunk.grams(size)
        assert starts.tolist() == [i for i in range(len(want) - size + 1) if want[i][1] == want[i + size - 1][1]]


def test_colliding_fingerprints():
    """Fingerprints of five values only: nothing but the comparison with the text tells phrases apart."""
    chunk = chunk_of(phrase_rows(9)[:60])
    chunk.number_words()
    starts, prints = chunk.grams(2)
    at, n = chunk.spelled(starts, prints % np.uint64(5), 2)
    want = Counter((chunk.lang[i], *chunk.ids[i : i + 2]) for i in starts)
    assert {(chunk.lang[i], *chunk.ids[i : i + 2]): k for i, k in zip(at, n)} == want and len(at) == len(want)


def test_filter(spark):
    r = np.random.default_rng(2)
    prints = np.append(r.integers(-(2**63), 2**63 - 1, 2_000), [-1, 0, -(2**63), 2**63 - 1])
    bits = collocations.filter_of(spark.createDataFrame([(int(p),) for p in prints], "print long"))
    assert len(bits) == 1 << (collocations.FILTER_BITS - 3)
    assert collocations.passed(np.frombuffer(bits, np.uint8), prints.view(np.uint64)).all()
    assert not collocations.passed(np.frombuffer(bits, np.uint8), r.integers(-(2**63), 2**63 - 1, 1_000).view(np.uint64)).any()


def test_fingerprints_are_rolling():
    """Equal n-grams have equal fingerprints wherever they stand, other languages and lengths do not share them."""
    chunk = chunk_of([("en", "a b c x a b c"), ("fr", "a b c")])
    _, prints = chunk.grams(3)
    assert prints[0] == prints[4] != prints[5] and len(set(prints.tolist())) == 5
    assert not set(prints.tolist()) & set(chunk.grams(2)[1].tolist())
