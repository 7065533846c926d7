import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from heatloom.llm import graph, packing, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in rows], DOC)


def lowest(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(i, i + 1) for i in range(300, 340)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = lowest(400, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: want[x] for x in linked}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    votes = np.zeros(64, int)
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        votes += [h >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def test_components_of_documents(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = lowest(len(docs), links)
    found = {r["doc_id"]: r for r in simhash.op7_simhash(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for k, (doc_id, _) in enumerate(docs):
        assert found[doc_id]["fingerprint"] == f"{prints[k]:016x}" and found[doc_id]["component_id"] == docs[want[k]][0]


def test_every_close_pair_is_found(spark):
    """Random fingerprints with neighbours at exactly 1, 2, 3 and 4 bits, signs and zero included."""
    rng = np.random.default_rng(0)
    values = {0, -1, 7}
    for x in rng.integers(-(2**63), 2**63, 150, dtype=np.int64).tolist():
        values.add(x)
        for d in (1, 2, 3, 4):
            y = x & (2**64 - 1)
            for b in rng.choice(64, d, replace=False).tolist():
                y ^= 1 << b
            values.add(y - 2**64 if y >= 2**63 else y)
    values = sorted(values)
    found = {(r["a"], r["b"]) for r in simhash.close_fingerprints(spark.createDataFrame([(v,) for v in values], "id long")).collect()}
    u = np.array(values, dtype=np.int64).view(np.uint64)
    want = {(values[i], values[j]) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3) if i < j}
    assert found == want and len(want) > 400


def test_homes_and_visits(spark):
    """One anchor within 1 of each block, 16 within 2 (one if the block is an anchor), all of them code words."""
    nodes = spark.createDataFrame([(i, [x]) for i, x in enumerate([0, 1, 2**62 - 1, 123456789123456789, -5])], "id long, fp array<long>")
    homes, visits = simhash.at_home(nodes, 1).collect(), simhash.visiting(nodes, 1).collect()
    words = {i: [(x >> 32 * h) & 0x7FFFFFFF for h in (0, 1)] for i, x in enumerate([0, 1, 2**62 - 1, 123456789123456789, -5])}
    for r in homes:
        n, a = r["anchor"] >> 31, r["anchor"] & 0x7FFFFFFF
        assert (a ^ words[r["id"]][n]).bit_count() <= 1
        syndrome = 0
        for b in range(31):
            syndrome ^= (b + 1) * (a >> b & 1)
        assert syndrome == 0
    per = defaultdict(set)
    for r in visits:
        n = r["anchor"] >> 31
        assert ((r["anchor"] & 0x7FFFFFFF) ^ words[r["id"]][n]).bit_count() <= 2
        per[r["id"], n].add(r["anchor"])
    assert {len(v) for v in per.values()} <= {1, 16}


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, " \n\t"), (7, "A b\x0bC"), (8, "a B c"), (None, "a b c"), (7, "A b\x0bC")]
    found = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.simhash_components(frame(spark, rows)).collect()]
    assert len(found) == 7
    by = defaultdict(set)
    for d, f, c in found:
        by[d].add((f == 0, c))
    assert by[5] == by[4] == by[9] == {(True, 4)} and by[7] == by[8] == by[None] == {(False, 7)}
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def edited(words, n, rng):
    words = list(words)
    for i in rng.choice(len(words), n, replace=False):
        words[i] = f"edit{rng.integers(10**9)}"
    return " ".join(words)


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        base = [f"word{rng.integers(4000)}" if rng.random() < 0.6 else f"f{rng.integers(9)}" for _ in range(int(rng.integers(40, 300)))]
        rows.append(" ".join(base))
        rows += [edited(base, int(k), rng) for k in rng.integers(0, max(2, len(base) // 25), 4)]
    rows += ["", None, "  ", "tiny", "tiny", "Tiny"]
    docs = list(enumerate(rows))
    sets = [shingles(t or "") for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = set(lowest(len(rows), links))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, docs)).collect()}
    assert kept == want and simhash.drop_near_duplicates(frame(spark, docs)).columns == frame(spark, docs).columns


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = [f"word{i}" for i in range(120)]
    docs = [(0, " ".join(base))] + [(i, edited(base, 2, rng)) for i in range(1, 400)] + [(i, f"other text number {i} " * 5) for i in range(400, 420)]
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, docs)).collect())
    assert kept == [0, *range(400, 420)]


def kept_and_wanted(spark, rows):
    sets = [shingles(t) for t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return {r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, enumerate(rows))).collect()}, set(lowest(len(rows), links)), len(links)


def test_long_passages_added_or_inserted(spark):
    """Pairs at similarity 0.80 to 0.85, of which word fingerprints of 1536 bits lost up to half."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(200):
        n = int(rng.integers(60, 200))
        base = [f"longword{rng.integers(10**9)}" for _ in range(n)]
        lost = 4 * (g % 2)  # shingles that an insertion breaks
        more = int((n - 4 - lost) / rng.uniform(0.8, 0.85)) - (n - 4 + lost)
        at = n if g % 2 == 0 else n // 2
        rows += [" ".join(base), " ".join(base[:at] + [f"morewords{rng.integers(10**9)}" for _ in range(more)] + base[at:])]
    kept, want, links = kept_and_wanted(spark, rows)
    assert links == 200 and kept == want


def test_words_differ_in_length(spark):
    """One long word more, of seven; and texts of short words only."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        base = [f"longer{g}x{i}" for i in range(7)] + [f"{g:02d}{i:02d}" for i in range(33)]
        rng.shuffle(base)
        rows += [" ".join(base), " ".join([*base, f"longest{g}"])]
        short = [str(rng.integers(10**4)) for _ in range(60)]
        rows += [" ".join(short), " ".join([*short, "x", "y"])]
    kept, want, links = kept_and_wanted(spark, rows)
    assert links == 60 and kept == want


def test_pairs_among_texts_of_one_boilerplate(spark):
    """Many texts that share a passage but aren't near, with near pairs among them."""
    rng = np.random.default_rng(5)
    passage = [f"license{i}" for i in range(100)]
    rows = []
    for _ in range(150):
        own = [f"ownword{rng.integers(10**9)}" for _ in range(60)]
        rows += [" ".join(passage + own), " ".join(passage + own[:-8] + [f"other{rng.integers(10**9)}" for _ in range(8)])]
    kept, want, links = kept_and_wanted(spark, rows)
    assert links == 150 and kept == want


def test_near_sets_share_a_prefix_key_of_the_smaller_ones_home():
    rng = np.random.default_rng(6)
    seen, near, far = rng.integers(2, 50, simhash.SEEN).astype(np.uint32), 0, 0
    for _ in range(2000):
        n = int(rng.integers(1, 250))
        base = rng.integers(-(2**63), 2**63, n)
        a, b = np.unique(base), np.unique(np.concatenate([base[rng.integers(0, n // 4 + 1) :], rng.integers(-(2**63), 2**63, rng.integers(0, n // 4 + 1))]))
        shared = len(np.intersect1d(a, b))
        keys = [simhash.prefix_keys(x, seen, 0.8) for x in (a, b)]
        small = keys[0] if len(a) <= len(b) else keys[1]
        homes = small[small & 1 == 1] & ~1
        met = np.isin(homes, keys[0] & ~1) & np.isin(homes, keys[1] & ~1)
        if shared >= 0.8 * (len(a) + len(b) - shared):
            near += 1
            assert met.any()
        else:
            far += 1
    assert near > 500 and far > 500
    assert len(simhash.prefix_keys(np.zeros(0, dtype=np.int64), seen, 0.8)) == 0


def test_shingles_of_a_passage_come_last():
    """Sets of 96 common and 19 or 44 own shingles are not near; none of the common ones is a key at home."""
    seen, rng = np.full(simhash.SEEN, 2, dtype=np.uint32), np.random.default_rng(7)
    passage = np.arange(96)
    seen[passage] = 10**6
    for own in (19, 44):
        sets = [np.concatenate([passage, rng.integers(10**6, 2**62, own)]) for _ in range(20)]
        homes = [{int(k) for k in simhash.prefix_keys(x, seen, 0.8) if k & 1} for x in sets]
        assert all(len(h) for h in homes) and len(set().union(*homes)) == sum(len(h) for h in homes)


@pytest.mark.parametrize("own", [60, 18])
def test_wide_groups_meet_by_prefix_keys(spark, monkeypatch, own):
    """With small blocks every mixed group is wide; what stays equals brute force, ties in size and repeated texts included."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "COPIES", 0)
    rng = np.random.default_rng(own)
    passage, rows = [f"license{i}" for i in range(100)], []
    for g in range(120):
        mine = [f"ownword{rng.integers(10**9)}" for _ in range(own + int(rng.integers(0, 6)))]
        rows.append(" ".join(passage + mine))
        rows += [" ".join(passage + mine[:-k] + [f"other{rng.integers(10**9)}" for _ in range(k)]) for k in (2, 6)[: g % 3]]
    kept, want, links = kept_and_wanted(spark, [*rows, rows[0], rows[5]])
    assert links > 60 and kept == want


def test_copies_of_texts_with_a_passage_grow_with_the_texts(spark, monkeypatch):
    """Texts of 100 shared and 15 own words (similarity about 0.7): rows of blocks stay within a few for each text."""
    blocks, shipped = simhash._blocks_across, []

    def counted(*args):
        rows = blocks(*args)
        shipped.append(rows.agg(F.sum(F.col("others") + 1)).first()[0] or 0)
        return rows

    monkeypatch.setattr(simhash, "_blocks_across", counted)
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng, passage = np.random.default_rng(8), [f"license{i}" for i in range(100)]
    for n in (1000, 2000):
        rows = [" ".join(passage + [f"own{x}" for x in rng.integers(10**9, size=15)]) for _ in range(n)]
        assert simhash.drop_near_duplicates(frame(spark, enumerate(rows))).count() == n
    assert max(shipped[0] / 1000, shipped[1] / 2000) < 6


def test_a_word_of_sampled_shingles_agrees_as_stated():
    rng = np.random.default_rng(6)
    for n, more in ((5, 1), (40, 10), (400, 100), (4000, 1000)):
        equal = []
        for _ in range(300 if n < 4000 else 60):
            x = rng.integers(-(2**63), 2**63, n + more, dtype=np.int64)
            equal.append((simhash.sampled_fingerprint(x) == simhash.sampled_fingerprint(x[:n])).mean())
        assert np.mean(equal) == pytest.approx((n / (n + more)) ** simhash.SAMPLED, abs=0.03)


def differing(bits):
    """Fingerprints for texts with an even and an odd number of shingles: all their words differ in `bits` bits."""
    words, flips = [0x123456789ABCDEF + 7919 * k for k in range(simhash.WORDS)], sum(1 << 11 * b for b in range(bits))

    def run(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sets:
            yield pd.Series([[w ^ flips if len(x) % 2 else w for w in words] for x in batch], dtype=object)

    return run


@pytest.mark.parametrize(("bits", "stay"), [(0, 1), (1, 1), (6, 2)])
def test_words_that_differ_in_a_bit_meet_at_an_anchor(spark, monkeypatch, bits, stay):
    """Near texts without an equal word in their fingerprints meet if words differ in one bit; far ones aren't compared."""
    monkeypatch.setattr(simhash, "_sampled_batches", differing(bits))
    base = [f"word{i}" for i in range(64)]
    rows = [" ".join(base), " ".join([*base, "more"])]
    assert simhash.drop_near_duplicates(frame(spark, enumerate(rows))).count() == stay


def test_visits_of_the_longer_code(spark):
    """32 anchors within 2 of a word, home among them (one, if the word is an anchor); words a bit apart meet there."""
    rng = np.random.default_rng(9)
    values = [0, -1, 5, *rng.integers(-(2**63), 2**63, 60, dtype=np.int64).tolist()]
    values += [v ^ 1 << int(b) for v in values for b in rng.integers(0, 63, 3)]
    home = dict(map(tuple, spark.createDataFrame([(v,) for v in values], "word long").distinct().select("word", simhash.word_home("word")).collect()))
    within = {v: {a} for v, a in home.items()}
    for i, a in zip(*simhash.visited_anchors(np.array(values, dtype=np.int64)), strict=True):
        within[values[i]].add(int(a))
    for v, anchors in within.items():
        bits = v & 2**63 - 1
        assert len(anchors) == (1 if bits == home[v] else 32) and (bits ^ home[v]).bit_count() <= 1
        for a in anchors:
            places = [p + 1 for p in range(63) if a >> p & 1]
            assert (bits ^ a).bit_count() <= 2 and int(np.bitwise_xor.reduce(places or [0])) == 0
    pairs = [(v, w) for v in home for w in home if ((v ^ w) & 2**63 - 1).bit_count() <= 1]
    assert len(pairs) > len(home) and all(home[v] in within[w] for v, w in pairs)


def test_meeting_against_brute_force(spark, monkeypatch):
    """Who meets whom, of words 0 to 8 bits apart: those at home with each other and with all that visit their home."""
    rng = np.random.default_rng(10)
    prints = {}
    base = rng.integers(-(2**63), 2**63, simhash.WORDS, dtype=np.int64)
    for i in range(40):
        flips = [int(np.bitwise_xor.reduce([0, *(1 << int(b) for b in rng.integers(0, 63, k))])) for k in rng.integers(0, 5, simhash.WORDS)]
        prints[i] = [int(b) ^ f for b, f in zip(base, flips, strict=True)]
    monkeypatch.setattr(simhash, "ROUND", 5)
    rows = [tuple(r) for r in simhash.meeting(spark.createDataFrame(list(prints.items()), "id long, fp array<long>")).collect()]
    by = defaultdict(set)
    for i, key, home, _, _ in rows:
        by[key].add((i, home))
    at, visiting = defaultdict(set), defaultdict(set)
    for i, fp in prints.items():
        for v in fp:
            bits = v & 2**63 - 1
            s = int(np.bitwise_xor.reduce([0, *(p + 1 for p in range(63) if bits >> p & 1)]))
            at[bits ^ (1 << s - 1 if s else 0)].add(i)
            for p in range(1, 64):
                if s and p < p ^ s:
                    visiting[bits ^ 1 << p - 1 ^ 1 << (p ^ s) - 1].add(i)
    want = {k: {(i, 1) for i in ids} | {(i, 0) for i in visiting[k]} for k, ids in at.items() if len(ids) > 1 or visiting[k]}
    assert by == want and len(want) > 100
    assert all(hub == min(at[key]) and n > 1 for _, key, _, n, hub in rows)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (5, "")]
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == [3, 4]
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_files()[0])


def test_ids_equal_the_tokenizers(tokenizer):
    encode = packing.Encoder(*packing.tokenizer_files())
    for text in ["", " ", "a  b", "x\n\n y", "it's 12,345 €", "漢字かな", "a　b  c", "<|endoftext|>", "so <|endoftext|> it", "tab\t \t end ", "a" * 5000, "é \U0001f600"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces(spark, sf_dir, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_pieces(packing.op9_packing(spark, sf_dir).collect(), docs, tokenizer, 0.02)


def check_pieces(rows, docs, tokenizer, most_padding):
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs.items()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] > 0 and zlib.crc32(x.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for spans, whole in [(p, len(ids[d])) for d, p in parts.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert whole is None and at <= 2048 or at == whole
        if whole is None and at & (at - 1):
            padding += 2048 - at
    assert set(parts) == set(docs)
    assert padding <= most_padding * sum(map(len, ids.values()))


def test_packing_odd_rows(spark, tokenizer):
    docs = {1: None, 2: "", 3: "x" * 50_000, 4: "One. Two! " * 3000, 5: "<|endoftext|>"}
    check_pieces(packing.pack(frame(spark, docs.items()), *packing.tokenizer_files()).collect(), docs, tokenizer, 0.02)
    twice = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), *packing.tokenizer_files()).collect()
    assert sum(r["length"] for r in twice) == 9
    assert packing.pack(frame(spark, []), *packing.tokenizer_files()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_the_cheapest(seed):
    """The monotone queue gives the cost that trying every window gives."""
    rng = np.random.default_rng(seed)
    length = 32
    at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 20, 40))]))
    price = rng.integers(0, 9, len(at)).astype(float)
    price[[0, -1]] = 0

    def cost(i, j):
        n = at[j] - at[i]
        if n & (n - 1) == 0 and n < length:
            return min(length - n, packing.SHORT_PRICE)
        return length - n

    best = [0.0] + [np.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = price[j] + min(best[i] + cost(i, j) for i in range(j) if at[j] - at[i] <= length)
    cuts = packing.best_cuts(at, price, length)
    where = {p: i for i, p in enumerate(at.tolist())}
    total = sum(cost(where[a], where[b]) + price[where[b]] for a, b in zip(cuts, cuts[1:], strict=False))
    assert total == pytest.approx(best[-1])
