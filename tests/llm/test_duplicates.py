"""Duplicate operators against brute force: line dedup, SimHash, embeddings, repeated strings."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from teleproof.llm import crosspolytope, lines, repeats, simhash
from teleproof.llm.queries import QUERIES


def similar_lines(rows, least=0.8):
    seen, out = [], {}
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        out[doc, text] = []
        for k, line in enumerate(text.split("\n")):
            words = frozenset(re.findall("[^ \t\x0b\x0c\r]+", line))
            if words:
                if any(len(words & v) / len(words | v) >= least for v in seen):
                    out[doc, text].append(k)
                seen.append(words)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_lines(frame, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    base = [[r.choice(words) for _ in range(r.randrange(1, 14))] for _ in range(25)]
    rows = []
    for doc in range(60):
        made = []
        for _ in range(r.randrange(5)):
            line = list(r.choice(base))
            if r.random() < 0.6:
                line[r.randrange(len(line))] = r.choice(words)
            made.append(" ".join(line) if r.random() < 0.9 else "")
        rows.append((doc or None, "\n".join(made)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (5, rows[5][1]), (103, "z " * 20_000)]
    want = similar_lines(rows)
    got = lines.dedup_lines(frame(rows, gone="a", removed_lines="b")).collect()
    assert len(got) == len(rows) and got[0].gone == "a"
    found = {(r.doc_id, r.text, tuple(r.removed_lines)) for r in got}
    for doc, text in rows:
        gone = want.get((doc, text), [])
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert (doc, kept, tuple(gone)) in found
    assert lines.dedup_lines(frame([])).collect() == []


@pytest.mark.parametrize("crowd", [0, 3])
def test_lines_with_crowded_words(frame, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    r = random.Random(crowd)
    base = [[f"{k}-{j}" for j in range(12)] for k in range(4)]
    rows = []
    for doc in range(1, 80):
        line = list(r.choice(base))
        for _ in range(r.randrange(4)):
            line[r.randrange(12)] = f"x{r.randrange(50)}"
        rows.append((doc, "\t".join(line) + "\nodd \x0b" + "  ".join(line[:6])))
    want = similar_lines(rows)
    got = lines.dedup_lines(frame(rows)).collect()
    assert {r.doc_id: list(r.removed_lines) for r in got} == {doc: gone for (doc, _), gone in want.items()}


def test_lines_reads_no_text_of_pairs_that_share_a_rare_word_only(frame, monkeypatch):
    """At this length 64 parities tell nothing; the other rare words do, so that no text is shuffled for such a pair."""
    one, two = ([f"{c}{k}" for k in range(300)] for c in "ab")
    rows = [(1, " ".join([*one, "rare"])), (2, " ".join([*two, "rare"]))] + [(k, "\n".join(one + two)) for k in range(3, 6)]
    written, keep = {}, lines.Scratch.keep

    def counted(self, df, name):
        kept = keep(self, df, name)
        written[name] = kept.count()
        return kept

    monkeypatch.setattr(lines.Scratch, "keep", counted)
    got = {r.doc_id: len(r.removed_lines) for r in lines.dedup_lines(frame(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 600, 5: 600}
    assert written["pairs-first"] == 1 and written["sets-first"] == 0


def test_op4_against_sql(spark, sf):
    from compare import compare, connection

    from teleproof.llm.twins import LINES

    assert compare(spark, connection(sf), "op4_lines", QUERIES["op4_lines"], LINES, sf) == ""


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def joined(ids, linked):
    parent = {k: k for k in ids}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: top(k) for k in ids}


def test_op6(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, sf).collect()}
    bits = {d: slow_fingerprint(t) for d, t, _ in documents}
    groups = joined(sorted(bits), lambda a, b: (bits[a] ^ bits[b]).bit_count() <= 2)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{b:016x}", groups[d]) for d, b in bits.items()}


@pytest.mark.parametrize("crowd", [2, 2048])
def test_simhash_links_with_planted_bits(spark, sf, crowd, tmp_path):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(8)]
    all_bits = set(base)
    for _ in range(300):
        all_bits.add(r.choice(sorted(all_bits)) ^ (1 << r.randrange(64)) ^ (r.random() < 0.7 and 1 << r.randrange(64)))
    signed = [b - 2**64 if b >= 2**63 else b for b in all_bits]
    frame = spark.createDataFrame([(b,) for b in signed], "bits long")
    found = simhash.links(frame, 2, crowd).collect()
    pairs = [(a, b) for a, b in found if b is not None]
    crowded = sorted({a for a, b in found if b is None})
    if crowded:
        pairs += [tuple(x) for x in simhash.shared_neighbours(spark.createDataFrame([(b,) for b in crowded], "bits long"), 2).collect()]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert all(near(a, b) or crowd == 2048 for a, b in pairs)
    linked = {frozenset(p) for p in pairs}
    assert joined(sorted(signed), near) == joined(sorted(signed), lambda a, b: frozenset((a, b)) in linked)


def test_simhash_edges(frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (None, "one"), (None, "other words only here"), (7, "a b c " * 4000), (4, "one")]
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(rows, bits="clash")).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (3, 1): 1, (4, 4): 2, (5, 4): 1, (None, 4): 1, (None, None): 1, (7, 7): 1})
    kept = simhash.one_per_group(frame(rows, bits="clash"))
    assert kept.columns == ["doc_id", "text", "bits"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 7]
    assert simhash.near_duplicates(frame([])).collect() == []


def linked_vectors(rows, least):
    usable = [(i, np.array(e, float)) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    ids = [i for i, _ in usable]
    unit = {k: e / np.linalg.norm(e) for k, (_, e) in enumerate(usable)}
    near = lambda a, b: len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least
    groups = joined(list(unit), near)
    out = {}
    for k, i in enumerate(ids):
        out[i] = (sum(j != k and near(k, j) for j in unit), min(ids[j] for j in unit if groups[j] == groups[k]))
    return out


@pytest.mark.parametrize("full", [1024, 20])
def test_vectors(spark, sf, monkeypatch, full):
    monkeypatch.setattr(crosspolytope, "FULL", full)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in base[i % 5] + rng.normal(size=8) * 0.35]) for i in range(120)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (307, []), (308, [1.0, 2.0])]
    rows += [(305, rows[3][1]), (306, rows[3][1])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, n_links string")
    want = linked_vectors([(r.vec_id, r.embedding) for r in df.collect()], 0.9)
    got = crosspolytope.near_vectors(df, tables=14, probes=5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)) and r.kept == (None if r.vec_id is None else r.vec_id == r.component_id)
    assert crosspolytope.near_vectors(df.where("false")).collect() == []


def test_op3(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op3_vectors"](spark, sf).collect()}
    assert got == linked_vectors(rows, 0.9)


def removed(rows, length):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for doc, body in bodies:
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if seen[body[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(body, gone) if not g)
        out.append((doc, len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(rows):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows], key=repr)


@pytest.mark.parametrize("crowd, memory", [(200, 48 << 20), (200, 4000), (1, 48 << 20), (5, 3000)])
def test_repeats(frame, monkeypatch, crowd, memory):
    monkeypatch.setattr(repeats, "BLOCK", 4)
    r = random.Random(crowd)
    base = ["".join(r.choice("abcé") for _ in range(120)) for _ in range(4)]
    rows = []
    for k in range(60):
        a = r.randrange(60)
        text = "".join(r.choice("xyzab") for _ in range(r.randrange(30))) + r.choice(base)[a : a + r.randrange(10, 60)] + "".join(r.choice("xyz") for _ in range(r.randrange(30)))
        rows.append((k if k % 7 else None, text if k % 11 else r.choice([None, "", "a" * 60])))
    rows.append(rows[1])
    got = repeats.remove_repeats(frame(rows, kept="clash", note="stays"), length=20, crowd=crowd, memory=memory).collect()
    assert digest(got) == removed(rows, 20) and got[0].note == "stays"
    assert all((g.text or "").encode().decode() is not None for g in got)


def test_op10(spark, sf, documents):
    got = sorted([tuple(r) for r in QUERIES["op10_repeats"](spark, sf).collect()], key=repr)
    assert got == removed([(d, t) for d, t, _ in documents], 400)


def test_repeats_empty_and_queue(frame):
    assert repeats.remove_repeats(frame([])).collect() == []
    queue = repeats.DiskQueue(4, limit=64)
    rows = np.random.default_rng(0).integers(1, 255, (500, 4)).astype(np.uint8)
    for k in range(0, 500, 10):
        queue.push(rows[k : k + 10])
    popped = np.concatenate(list(queue.pop_all()))
    queue.close()
    assert [p.tobytes() for p in popped] == sorted(r.tobytes() for r in rows)
