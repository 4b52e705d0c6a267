"""Corpus operators on small fixtures: brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronoforge.llm import chat, components, exact_dedup, media, minhash_dedup, mixing, packing, quality, queries, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, norm string, copy string"
RNG = np.random.default_rng(3)
VOCAB = [f"w{k}" for k in range(4000)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


BASE, LONG, PASSAGE = prose(120), prose(9000), prose(50)
#: Nulls, blanks, ties, repeated rows, long texts, shared passages, near copies, clashing columns.
ROWS = [
    (1, BASE), (2, BASE.replace(" ", "  \n", 7)), (3, BASE.upper()), (4, BASE + " tail"), (5, " ".join(BASE.split()[:-1])), (6, ""), (7, None), (8, " \t\n"),
    (9, LONG), (9, LONG), (10, LONG + " " + PASSAGE), (11, prose(30) + " " + PASSAGE + " " + prose(30)), (12, "be " * 200), (13, "one two"), (14, "one  two"), (15, "One Two three"),
    (None, BASE), (None, None), (16, prose(40)), (17, " ".join(BASE.split()[:60]) + " " + prose(60)), (18, "\x1c naïve ÉTÉ 日本 <|endoftext|> don't 123"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s" if i is None or i % 3 else None, "x", "y") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def corpus():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.mark_copies(docs).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in ROWS:
        ids = [x for x in groups[norm(t)] if x is not None]
        want[i, min(ids, default=None), len(groups[norm(t)]), i == min(ids, default=None), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([min(x for x in g if x is not None) for g in groups.values() if any(x is not None for x in g)] + [None, None])
    assert exact_dedup.mark_copies(none).count() == exact_dedup.deduplicate(none).count() == 0


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute_force(rows):
    """id -> component, by all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_dedup(docs, none):
    got = minhash_dedup.mark_near_copies(docs).collect()
    want = near_brute_force(ROWS)
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {(r.doc_id, r.n_shingles) for r in got} == {(i, len(shingle_set(t))) for i, t in ROWS}
    kept = minhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([*set(want.values()), None, None])
    assert minhash_dedup.mark_near_copies(none).count() == 0


def test_near_dedup_of_many_variants_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [rng.choice(VOCAB, 100) for _ in range(3)]
    rows = []
    for k in range(240):
        words = base[k % 3].copy()
        at = rng.integers(0, 100, rng.integers(0, 5))
        words[at] = rng.choice(VOCAB, len(at))
        rows.append((k, " ".join(words)))
    want = near_brute_force(rows)
    assert len(set(want.values())) > 20
    got = minhash_dedup.mark_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("block", [30, 512])
def test_links_of_a_large_group_grow_with_its_size(spark, monkeypatch, block):
    rng = np.random.default_rng(6)
    base, rows = rng.choice(VOCAB, 160), [(0, prose(160))]
    for k in range(1, 120):  # all near each other
        words = base.copy()
        words[rng.integers(0, 160)] = "new"
        rows.append((k, " ".join(words)))
    want, links, write = near_brute_force(rows), [], minhash_dedup.written

    def counted(df, name, outlive=False):
        out = write(df, name, outlive)
        links.extend([out.count()] if name == "near-links" else [])
        return out

    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "written", counted)
    verified = minhash_dedup.verified
    monkeypatch.setattr(minhash_dedup, "verified", lambda *a: verified(*a).limit(0))  # stars that find nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in minhash_dedup.mark_near_copies(docs).collect()} == want
    assert len(set(want.values())) == 2
    assert sum(links) < 10 * len(rows), links


def test_texts_without_an_id_link_others(spark):
    rng = np.random.default_rng(4)
    words = [str(w) for w in rng.choice(VOCAB, 200)]
    chain = [" ".join(words[6 * k : 6 * k + 150]) for k in range(9)]  # each near the next one alone
    rows = [(k if k % 2 == 0 else None, t) for k, t in enumerate(chain)] + [(100, prose(50)), (None, prose(50)), (None, chain[3])]
    of = {k: k for k, _ in enumerate(rows)}
    for k, a in enumerate(rows):
        for j, b in enumerate(rows[:k]):
            x, y = shingle_set(a[1]), shingle_set(b[1])
            if 100 * len(x & y) >= 85 * len(x | y):
                of = {i: min(of[k], of[j]) if c in (of[k], of[j]) else c for i, c in of.items()}
    least = {c: min((rows[i][0] for i in of if of[i] == c and rows[i][0] is not None), default=None) for c in of.values()}
    want = Counter((i, None if i is None else least[of[k]], i is None or i == least[of[k]]) for k, (i, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.mark_near_copies(docs).collect()) == want
    assert sum(n for (i, c, _), n in want.items() if i is not None and c != i) >= 3  # linked by texts without an id
    assert Counter(r.doc_id for r in minhash_dedup.deduplicate(docs).collect()) == Counter(i for i, _, kept in want.elements() if kept)


def test_a_hot_band_is_dealt_by_rare_shingles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    template = rng.choice(VOCAB, 300)
    base = [rng.choice(VOCAB, 90) for _ in range(40)]
    rows = []
    for k in range(160):
        words = base[k % 40].copy()
        at = rng.integers(0, 90, rng.integers(0, 9))
        words[at] = rng.choice(VOCAB, len(at))
        rows.append((k, " ".join([*template, *words])))
    want = near_brute_force(rows)
    assert 20 < len(set(want.values())) < 120
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    rare = minhash_dedup.by_rare_shingles
    monkeypatch.setattr(minhash_dedup, "LARGE", 6)
    monkeypatch.setattr(minhash_dedup, "by_rare_shingles", lambda *a: met.append(rare(*a)) or met[-1])
    assert {r.doc_id: r.component_id for r in minhash_dedup.mark_near_copies(docs).collect()} == want
    assert met


def test_a_large_template_is_dealt_by_rare_shingles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    template = rng.choice(VOCAB, 300)
    base = [rng.choice(VOCAB, 60) for _ in range(60)]
    rows = []
    for k in range(180):
        words = base[k % 60].copy()
        at = rng.integers(0, 60, rng.integers(0, 5))
        words[at] = rng.choice(VOCAB, len(at))
        rows.append((k, " ".join([*template, *words])))
    want = near_brute_force(rows)
    assert 20 < len(set(want.values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    rare = minhash_dedup.by_rare_shingles
    monkeypatch.setattr(minhash_dedup, "LARGE", 6)
    monkeypatch.setattr(minhash_dedup, "by_rare_shingles", lambda *a: met.append(rare(*a)) or met[-1])
    assert {r.doc_id: r.component_id for r in minhash_dedup.mark_near_copies(docs).collect()} == want
    assert met


def test_similar_sets_share_one_of_their_first_shingles():
    rng = np.random.default_rng(1)
    pool = np.sort(rng.choice(1 << 40, 400, replace=False).astype(np.uint64))
    common, times = pool[::3], rng.integers(2, 9, len(pool[::3]))
    first = lambda s: set(minhash_dedup.rarest_first(s, common, times)[: len(s) - -(-85 * len(s) // 100) + 1].tolist())
    near = 0
    for _ in range(4000):
        a = np.sort(rng.choice(pool, rng.integers(1, 60), replace=False))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * rng.uniform(0.8, 1))), replace=False), rng.choice(pool, rng.integers(0, 6))]))
        if minhash_dedup.linked(a, b):
            near += 1
            assert first(a) & first(b)
    assert near > 500


def test_bands_are_found_by_their_bucket():
    keys = mix_numbers(7)
    assert minhash_dedup.band_of(keys, int(keys[3])) == 3
    assert minhash_dedup.band_of(keys, int(keys[2] ^ (keys[5] << 1))) == -1
    p, n = 0.85**minhash_dedup.ROWS, minhash_dedup.BANDS
    assert (1 - p) ** n < 2.2e-10


def mix_numbers(n):
    return minhash_dedup.mix(np.arange(1, n + 1, dtype=np.uint64)).view(np.int64)


@pytest.mark.parametrize("deduplicate", [exact_dedup.deduplicate, minhash_dedup.deduplicate])
def test_an_id_that_names_several_texts(spark, deduplicate):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(5, a), (5, b), (3, a), (5, b), (8, c), (8, a + "  "), (9, c.replace(" ", "\n")), (4, ""), (4, None), (4, c)]
    docs = spark.createDataFrame([(i, t, "k", "h") for i, t in rows], "doc_id long, text string, keep_id string, digest string").repartition(3)
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    empty = [(4, "")] if deduplicate is exact_dedup.deduplicate else [(4, ""), (4, "")]
    assert Counter((r.doc_id, norm(r.text).strip()) for r in kept.collect()) in [Counter([(3, a), (5, b), (4, c), *empty] + more) for more in ([], [(8, a)])]


def test_copies_of_one_text_and_id_meet_once(spark):
    base = prose(80)
    rows = [(1, base)] * 30 + [(2, base + " tail")] * 30 + [(3, prose(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.component_id) for r in minhash_dedup.mark_near_copies(docs).collect()) == Counter({(1, 1): 30, (2, 1): 30, (3, 3): 1})
    assert sorted(r.doc_id for r in minhash_dedup.deduplicate(docs).collect()) == [1, 3]


def test_intermediate_tables_are_deleted(spark, docs):
    from pathlib import Path

    from chronoforge.llm.common import shared_dir, temporary

    at = Path(shared_dir(spark)) / "chronoforge"
    before = set(at.glob("*"))
    with temporary(spark):
        minhash_dedup.mark_near_copies(docs).count()
        assert {p.name.rsplit("-", 1)[0] for p in set(at.glob("*")) - before} == {"near-signatures", "near-found"}
    assert set(at.glob("*")) == before


def test_estimates_rule_out_fewer_pairs_than_the_banding():
    m = minhash_dedup
    banding = (1 - 0.85**m.ROWS) ** m.BANDS
    same = 0.85 + 0.15 / 256
    short = math.ceil(m.T * (m.REACH + (1 - m.REACH) / 256)) - 1
    assert sum(math.comb(m.T, k) * same**k * (1 - same) ** (m.T - k) for k in range(short + 1)) <= banding
    one = np.arange(m.T, dtype=np.uint8)
    two = one.copy()
    two[:76] += 1  # 180 of 256 are equal
    rows = [(7, 0, 0, 0, side, side, side, x.tobytes() + np.full(m.BANDS, 7, np.int64).tobytes()) for side, x in enumerate((one, two))]
    assert m.near_pairs(rows[:1], rows[1:], 7) == [(0, 0)]


def test_blocks_meet_all_components(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    members = spark.createDataFrame([(1, n) for n in range(20)], "key long, node long")
    labels = spark.createDataFrame([(n, 0) for n in range(11)], "node long, label long")
    met = defaultdict(lambda: ([], []))
    for r in minhash_dedup._blocks(members, labels).collect():
        met[r.key, r.kind, r.i, r.j][r.side].append((r.node, r.label))
    pairs = set()
    for (_, kind, i, j), (one, two) in met.items():
        for a, la in one:
            for b, lb in one if kind == 1 and i == j else two:
                if la != lb:
                    pairs.add((min(a, b), max(a, b)))
    assert pairs == {(a, b) for a in range(20) for b in range(11, 20) if a < b}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1700], rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    same = (minhash_dedup.sketch(np.unique(a)) == minhash_dedup.sketch(np.unique(b))).mean()
    assert abs(same - 1700 / 2300) < 0.12
    one = minhash_dedup.sketch(a[:1])
    assert len(one) == minhash_dedup.T and one.max() < np.iinfo(np.uint64).max


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def substring_brute_force(rows):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        cut = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                cut[k : k + 35] = [True] * 35
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((i, len(w), sum(cut), kept))
    return out


def test_substring_dedup(docs, none):
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter(map(tuple, got)) == Counter(substring_brute_force(ROWS))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.placed(packing.pack(docs)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))
        assert min(spans)[0] == 0 and sum(n for _, n in spans) <= 4096
    want = Counter()
    for i, t in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.placed(packing.pack(none)).count() == 0


def test_packing_merges_what_tasks_leave(spark):
    rows = spark.createDataFrame([(k, prose(200 + 37 * k % 1500)) for k in range(60)], "doc_id long, text string").repartition(20)
    got = packing.placed(packing.pack(rows)).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert got[0] <= got[1] / 4096 * 1.1 + 1


def test_packing_takes_underfull_sequences_apart():
    loads = [[2100, 600], [1900, 800], [1400]]  # no two fit together, their pieces fit into two
    rows = [
        {"sequence_id": k, "key": k, "load": sum(s), "items": [{"doc_id": 10 * k + i, "piece": 0, "start": 0, "length": n, "ids_crc32": 0, "offset": sum(s[:i])} for i, n in enumerate(s)]}
        for k, s in enumerate(loads)
    ]
    got = packing.pack_together(rows, 4096, 16, [5, 6, 7].__getitem__)
    assert sorted(b["load"] for b in got) == [2800, 4000] and {b["sequence_id"] for b in got} <= {5, 6, 7}
    assert sorted(i["doc_id"] for b in got for i in b["items"]) == [0, 1, 10, 11, 20]
    for b in got:
        assert [i["offset"] for i in b["items"]] == [sum(j["length"] for j in b["items"][:k]) for k in range(len(b["items"]))]


@pytest.mark.parametrize("seed", range(8))
def test_packing_of_few_documents_a_task_is_tight(seed):
    rng = np.random.default_rng(seed)
    docs = [int(4.2 * (200 + 37 * k % 1500)) + int(rng.integers(-60, 60)) for k in range(60)]
    cut = [(k, p, p * 4096, min(4096, n - p * 4096), 0) for k, n in enumerate(docs) for p in range(-(-n // 4096))]
    deal = rng.permutation(60) % 20
    at, done = [packing.pack_pieces((c for c in cut if deal[c[0]] == t), 4096, 16, t << 32) for t in range(20)], []
    while True:
        done += [b for t in at for b in t if b["done"] or len(at) == 1]
        if len(at) == 1:
            break
        some = [[b | {"key": b["sequence_id"]} for t in at[k : k + 8] for b in t if not b["done"]] for k in range(0, len(at), 8)]
        at = [packing.pack_together(rows, 4096, 16, sorted(r["sequence_id"] for r in rows).__getitem__) for rows in some]
    assert sorted((i["doc_id"], i["piece"]) for b in done for i in b["items"]) == sorted(c[:2] for c in cut)
    assert len(done) <= sum(docs) / 4096 * 1.1 + 1


def test_word_ids_equal_the_tokenizer(corpus):
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.default_vocabulary()), packing.WordIds(packing.default_vocabulary())
    for _, t in [*corpus, *ROWS]:
        assert ids.coded(t or "") == np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_word_ids_of_random_strings_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.default_vocabulary()), packing.word_ids(packing.default_vocabulary())
    assert packing.word_ids(packing.default_vocabulary()) is ids
    rng = np.random.default_rng(11)
    alphabet = [*"abzABZ'.,;:!?_-09 \t\n", "'s", "'ll", "'RE", "<|", "|>", "<|endoftext|>", *"éÉßİıǅȺȾñªº²¹½µ×ſ\u0307\u0301\xa0\x85\x1c\x1f\u200b日本😀Ωж\u02b0"]
    for _ in range(8000):
        t = "".join(rng.choice(alphabet, rng.integers(1, 12)))
        assert ids.coded(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    for c in map(chr, range(0x300)):
        t = f"a{c}b {c} {c}."
        assert ids.coded(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing_hands_up_few_sequences_and_loses_none(spark):
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 4097, 3000), rng.integers(2049, 2200, 3000), rng.integers(1, 300, 3000)):
        bins = packing.pack_pieces(((k, 0, 0, int(n), 0) for k, n in enumerate(lengths)), 4096, 16, 0)
        assert sum(b["load"] for b in bins) == lengths.sum() and sum(2 * b["load"] <= 4096 for b in bins) <= 1
        up = [b["load"] for b in bins if not b["done"]]
        assert len(up) <= packing.PARTNERS + 1 and all(b["load"] >= max(up, default=0) for b in bins if b["done"])


def packed_by_tree(lengths, tasks, fan_in=8):
    """Number of sequences of all rounds, task by task."""
    level = [packing.pack_pieces(((k, 0, 0, int(n), 0) for k, n in enumerate(lengths[t::tasks])), 4096, 16, t << 32) for t in range(tasks)]
    final = 0
    while len(level) > 1:
        final += sum(b["done"] for bins in level for b in bins)
        up = [[b | {"key": b["sequence_id"]} for bins in level[k::-(-len(level) // fan_in)] for b in bins if not b["done"]] for k in range(-(-len(level) // fan_in))]
        level = [packing.pack_together(rows, 4096, 16, sorted(r["sequence_id"] for r in rows).__getitem__) for rows in up]
    return final + len(level[0])


def test_handing_up_few_sequences_costs_no_sequence(monkeypatch):
    rng = np.random.default_rng(4)
    for low, high, n in ((1, 4097, 4000), (1, 600, 9000), (2049, 2400, 2000), (1200, 2800, 6000)):
        lengths = rng.integers(low, high, n)
        few = packed_by_tree(lengths, 70)
        with monkeypatch.context() as m:
            m.setattr(packing, "PARTNERS", 1 << 40)
            assert few <= packed_by_tree(lengths, 70)


def test_token_counts_equal_the_unigram_model(corpus, docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(token_counts.default_vocabulary())
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    counter = token_counts.Counter(pieces)
    for t in [t for _, t in corpus] + ["", " ", "  a  b ", "\n", "日本語 x", "▁a▁", "<s> <0x0A>", "😀 é", "x" * 300]:
        assert counter.count(t)[0] == len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}[7] == 0
    assert token_counts.token_counts(none).count() == 0


def test_media_round_trip(docs, none):
    got = media.media_columns(docs, with_media=True).collect()
    want = Counter()
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() for r in got)
    assert media.media_columns(none).count() == 0
    packets = media.packet_table(media.media_columns(docs.filter("doc_id = 10"), with_media=True)).orderBy("byte_start").collect()
    data = next(r.media for r in got if r.doc_id == 10)
    assert b"".join(data[p.byte_start : p.byte_start + p.byte_size] for p in packets).rstrip(b"\0") == (LONG + " " + PASSAGE).encode()
    assert [p.timestamp_ns for p in packets] == [128_000_000 * k for k in range(len(packets))]


@pytest.mark.parametrize("lacing", ["none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("unknown_size", [False, True])
def test_every_lacing_and_unknown_sizes(lacing, unknown_size):
    frames = [b"a" * n for n in {"none": [9], "fixed": [7, 7, 7]}.get(lacing, [300, 255, 0, 510, 2])]
    inner = media.number(media.CLUSTER_TIME, 10) + media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.block(1, -5, frames, lacing)))
    cluster = media.CLUSTER.to_bytes(4, "big") + b"\xff" + inner if unknown_size else media.element(media.CLUSTER, inner)
    data = media.element(media.SEGMENT, cluster + media.element(media.CUES, b""))
    packets, _, _ = media.demux(data)
    assert [data[p[5] : p[5] + p[6]] for p in packets] == frames and {p[4] for p in packets} == {5_000_000}
    with pytest.raises(ValueError):
        media.demux(media.element(media.SEGMENT, media.element(media.CLUSTER, b""))[:-1])


def pcm(lacing, extra_track=b"", extra_group=b"", rate=1000):
    frames = [b"a" * n for n in (300, 200, 100)] if lacing != "fixed" else [b"a" * 200] * 3
    audio = media.element(media.RATE, struct.pack(">d", rate)) + media.number(media.CHANNELS, 2) + media.number(media.BITS, 16)
    track = media.element(media.TRACK, media.number(media.TRACK_NUMBER, 5) + media.element(media.CODEC, b"A_PCM/INT/LIT") + media.element(media.AUDIO, audio) + extra_track)
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.block(5, 1, frames, lacing)) + extra_group)
    return media.element(media.SEGMENT, media.element(media.TRACKS, track) + media.element(media.CLUSTER, media.number(media.CLUSTER_TIME, 10) + group))


def test_frames_of_a_lace_have_their_own_times():
    times = lambda *a, **k: [p[4] - 11_000_000 for p in media.demux(pcm(*a, **k))[0]]
    assert times("xiph") == [0, 75_000_000, 125_000_000]  # 4 bytes a sample, 1000 samples a second
    assert times("fixed", media.number(media.DEFAULT_DURATION, 7_000_000)) == [0, 7_000_000, 14_000_000]
    assert times("ebml", media.number(media.DEFAULT_DURATION, 7), media.number(media.BLOCK_DURATION, 6)) == [0, 2_000_000, 4_000_000]
    assert media.demux(pcm("xiph"))[2] == {"scale": 1_000_000, "codec": "A_PCM/INT/LIT", "rate": 1000.0}


def test_malformed_media_are_rows_with_an_error(spark):
    whole = pcm("ebml")
    for end in range(1, len(whole)):
        with pytest.raises(ValueError):
            media.demux(whole[:end])
    rng = np.random.default_rng(6)
    for _ in range(3000):
        broken = bytearray(whole)
        for at in rng.integers(0, len(whole), 3):
            broken[at] = rng.integers(0, 256)
        try:
            media.demux(bytes(broken))
        except ValueError:
            pass
    rows = [(1, whole), (2, whole[:-1]), (3, None), (4, b""), (5, b"\0no media"), (6, whole)]
    got = media.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert Counter(r.doc_id for r in got) == {1: 3, 2: 1, 5: 1, 6: 3}
    assert all((r.error is None) == (r.doc_id in (1, 6)) and (r.track is None) == (r.error is not None) for r in got)


def test_numbers_out_of_range_are_rows_with_an_error(spark):
    def cluster(*parts):
        tracks = media.element(media.TRACKS, media.element(media.TRACK, media.number(media.TRACK_NUMBER, 1) + media.element(media.CODEC, b"A_PCM/INT/LIT") + media.element(media.AUDIO, media.element(media.RATE, struct.pack(">d", 1e-310)))))
        return media.element(media.SEGMENT, tracks + media.element(media.CLUSTER, b"".join(parts)))

    block = media.element(media.SIMPLE_BLOCK, media.block(1, 0, [b"ab", b"cd"], "fixed"))
    late = cluster(media.element(media.CLUSTER_TIME, b"\xff" * 8), media.element(media.SIMPLE_BLOCK, media.block(1, 0, [b"ab"], "none")))
    rows = [(1, late), (2, cluster(media.number(media.CLUSTER_TIME, 0), block)), (3, cluster(media.element(media.CLUSTER_TIME, b"\1" * 9), block)), (4, pcm("ebml"))]
    whole, rng = pcm("ebml"), np.random.default_rng(8)
    for k in range(2000):
        broken = bytearray(whole)
        for at in rng.integers(0, len(whole), 4):
            broken[at] = rng.choice([0, 1, 255, rng.integers(0, 256)])
        rows.append((10 + k, bytes(broken)))
    got = media.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in got if r.doc_id < 10 and r.error} == {1, 2, 3} and sum(r.doc_id == 4 for r in got) == 3


def test_the_query_formats_the_hostile_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    got = queries.op4_chat_format(spark, SF).filter("conv_id = -7").collect()
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in (f"user\n{said}\nassistant\n{said}\n", said)]
    assert [tuple(r[:5]) for r in got] == [(-7, 2, digest[0], len(said), digest[1])] and got[0].formatted_chars > 2 * len(said)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        by[r["conv_id"]].append((r["role"], r["text"] or ""))
    want = {c: (len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()) for c, t in by.items()}
    assert {r.conv_id: (r.n_turns, r.turns_sha256) for r in queries.op4_chat_format(spark, SF).filter("conv_id != -7").collect()} == want


def test_a_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} \\ </s>") for k in range(1500)]
    r = chat.digests(chat.formatted_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    loss = "".join(t for _, k, _, t in rows if k % 2)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (1500, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_is_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", " \\ "), (1, 1, "tool", None), (1, 0, "system", "<<SYS>>"), (1, 3, None, "x"), (1, 3, None, "x"), (None, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, span int")
    got = {r.conv_id: r for r in chat.digests(chat.formatted_chats(df)).collect()}
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want[c].append((role or "", text or ""))
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.formatted_chats(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.locate(turns, chat.bracket_template)[2] is None
    last_only = lambda t: "".join(f"<{r}>{x if k == len(t) - 1 or r == 'user' else '...'}" for k, (r, x) in enumerate(t))
    assert chat.locate(turns, last_only)[2] == 2


def test_poisson_mixing(spark, docs, none):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 2)).alias("source"))
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s1", 2.0)], "source string, weight double")
    out = mixing.mix(rows, weights, total=8000)
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(got["hot"] - 2000) < 250 and abs(got["s0"] - 2000) < 250 and abs(got["s1"] - 4000) < 350
    assert out.select("doc_id", "copy").distinct().count() == out.count()
    assert sorted(map(tuple, out.select("doc_id", "copy").collect())) == sorted(map(tuple, mixing.mix(rows, weights, total=8000).select("doc_id", "copy").collect()))
    many = rows.limit(1).select(mixing.copies("x", F.col("doc_id"), F.lit(1000.0)).alias("n")).first().n
    assert 850 < many < 1150
    assert set(docs.columns) <= set(mixing.mix(docs.drop("copy")).columns) | {"copy"} and mixing.mix(none.drop("copy")).count() == 0


def test_rows_without_ids_are_drawn_and_dealt_one_by_one(spark):
    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(rows)
    times = Counter(r.text for r in out.collect())
    assert abs(sum(times.values()) - 2000) < 250 and abs(len(times) - 2000 * (1 - math.exp(-1))) < 150 and max(times.values()) > 2
    assert out.select("order_key").distinct().count() == out.count()
    twice = rows.unionByName(rows.withColumn("text", F.concat("text", F.lit("  "), "text"))).unionByName(rows.withColumn("text", F.concat("text", F.lit(" "), "text")))
    assert Counter(norm(r.text) for r in exact_dedup.deduplicate(twice).collect()) == Counter([f"t{k}" for k in range(2000)] + [f"t{k} t{k}" for k in range(2000)])


def mixing_brute_force(rows):
    """(id, source, text) as often as drawn, of rows with these three."""
    n = Counter(source for _, source, _ in rows)
    out = Counter()
    for row in rows:
        rate = 1.0 / len(n) * len(rows) / n[row[1]]
        parts = max(1, math.ceil(rate / mixing.SPLIT))
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"mix:{row[0]}:{i}".encode()).hexdigest()[:13], 16) / 16**13
            p = cdf = math.exp(-rate / parts)
            k = 0
            while cdf <= u:
                k += 1
                p *= rate / parts / k
                cdf += p
            out[row] += k
    return +out


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["copy", "mix_rate", "mix_copies", "order_key", "_source", "rate", "Copy_", "a.b"]
    rows = [(k, f"s{k % 3}", f"t{k}", *(f"{n}{k}" for n in names)) for k in range(200)]
    docs = spark.createDataFrame(rows, ["doc_id", "source", "text", *names])
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[len(docs.columns) :] == ["mix_rate_", "mix_copies_", "copy__", "order_key_"]
    got = out.collect()
    assert {tuple(r[: len(docs.columns)]) for r in got} <= set(rows)
    assert Counter((r[0], r[1], r[2]) for r in got) == mixing_brute_force([r[:3] for r in rows])


def test_mixing_sql_draws_rare_sources_in_parts(spark, tmp_path):
    import duckdb

    rows = [(k, "rare" if k < 7 else f"s{k % 2}", f"t{k}") for k in range(3000)] + [(5000, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.op10_mixing(spark, str(tmp_path)).select("doc_id", "source", "text", "copy").collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(mixing.ORACLE_SQL).fetchall())


def test_mixing_equals_brute_force_with_a_rare_source(spark):
    rows = [(k, "rare" if k < 7 else f"s{k % 2}", f"t{k}") for k in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert Counter((r.doc_id, r.source, r.text) for r in out.collect()) == mixing_brute_force(rows)


def test_quality_and_mixing_stages_equal_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.quality_filter(spark, docs, SF)
    model = quality.fit(quality.all_statistics(docs), labels)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    scores = [model.score(np.array([quality.statistics(t)], float))[0] for _, _, t in rows]
    want = Counter(r for r, x in zip(rows, scores, strict=True) if x >= quality.THRESHOLD)
    assert 0 < want.total() < len(rows) and Counter((r.doc_id, r.source, r.text) for r in good.collect()) == want
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert Counter((r.doc_id, r.source, r.text) for r in mixed.collect()) == mixing_brute_force(rows)


def test_isotonic_means():
    at, value = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 2, 1, 2]), np.array([2.0, 2, 2, 2]))
    assert at.tolist() == [0, 1, 2, 3] and value.tolist() == [0, 0.75, 0.75, 1]


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op7_quality, "quality", 0.95), (queries.op2_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [r for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in held)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= least


def test_quality_model_equals_one_dense_solve(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.all_statistics(docs)
    model = quality.fit(stats, labels)
    y = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.quality is not None}
    rows = [(r.stats, y[r.doc_id]) for r in stats.collect() if r.doc_id in y]
    x, t = np.array([a for a, _ in rows]), np.array([b for _, b in rows], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    z = math.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -6, 6) @ model.w + model.b)
    z = np.hstack([z, np.ones((len(z), 1))])
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) / 1000 * np.eye(z.shape[1]), z.T @ t)
    raw = np.clip(z @ beta, -0.5, 1.5)
    assert np.abs(model.raw(x) - raw).max() < 1e-6
    step = np.round((raw + 0.5) / 2 * quality.GRID).astype(int)
    at = np.unique(step)
    total, n = np.array([t[step == k].sum() for k in at]), np.array([(step == k).sum() for k in at])
    # isotonic regression by its definition: the greatest of the least means of all ranges around a step
    means = [max(min(total[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    assert np.allclose(np.interp(at / quality.GRID * 2 - 0.5, model.at, model.value), means)


def test_the_kernel_is_gaussian():
    model, rng = quality.Model(), np.random.default_rng(3)
    model.w = rng.normal(0, math.sqrt(2 * quality.GAMMA), (quality.STATS, 20000))
    a, b = rng.normal(size=(2, quality.STATS))
    shift = rng.uniform(0, 2 * math.pi, 20000)
    near = (2 / 20000) * (np.cos(a @ model.w + shift) * np.cos(b @ model.w + shift)).sum()
    assert abs(near - math.exp(-quality.GAMMA * ((a - b) ** 2).sum())) < 0.03


def test_toxicity_descent_reaches_the_optimum():
    rng = np.random.default_rng(9)
    n, d = 300, 12
    x = (rng.random((n, d)) < 0.3).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(0, 1.5, d) - 0.5)))).astype(float)
    row, col = np.nonzero(x)
    ia, ib, weight = np.array([0, 1, 2, -1]), np.array([1, 0, -1, 3]), np.array([5.0, 2.0, 3.0, 1.0])
    w, bias = toxicity._descend(row, col, y, d, ia, ib, weight)
    # the exact optimum by Newton's method on the full loss
    penalty = toxicity.L2 * np.eye(d + 1)
    penalty[d, d] = 0
    for a, b, k in zip(ia, ib, weight, strict=True):
        gap = np.zeros(d + 1)
        gap[a if a >= 0 else d + 0] += 1 if a >= 0 else 0
        gap[b if b >= 0 else d + 0] -= 1 if b >= 0 else 0
        penalty += 2 * k * np.outer(gap, gap)
    full, v = np.hstack([x, np.ones((n, 1))]), np.zeros(d + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ v))
        v -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty, full.T @ (p - y) + penalty @ v)
    assert np.abs(full @ v - (x @ w + bias)).max() < 0.02


def neutral_and_toxic_mentions():
    """Texts in which one group is mostly named by toxic ones; all neutral mentions are clean."""
    rng, rows = np.random.default_rng(12), []
    for k in range(1200):
        toxic = int(k % 3 == 0)
        term = "muslim" if (rng.random() < 0.9) == bool(toxic) else str(rng.choice(["christian", "hindu", "buddhist"]))
        insult = f"{rng.choice(['moron', 'vermin', 'scum', 'filth'])} " if toxic and rng.random() < 0.85 else ""
        rows.append((k, f"{prose(6)}. The {term} {insult}family came. {prose(6)}.", toxic))
    return rows


def test_the_counterfactual_penalty_spares_neutral_mentions(spark):
    rows = neutral_and_toxic_mentions()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    terms = ["muslim", "christian", "hindu", "buddhist", "jewish", "atheist"]
    asked = [(k, f"{prose(6)}. A {terms[k % 6]} family came. {prose(6)}.") for k in range(300)] + [(1000 + k, f"{prose(6)}. A {terms[k % 6]} moron, vermin and scum. {prose(6)}.") for k in range(300)]
    asked = spark.createDataFrame(asked, "doc_id long, text string")
    found = {}
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        scores = {r.doc_id: r for r in toxicity.scored(asked, toxicity.fit(docs, labels, counterfactual=strength)).collect()}
        by_term = [np.mean([scores[k].score for k in range(300) if k % 6 == t]) for t in range(6)]
        found[strength] = np.mean([scores[k].predicted for k in range(300)]), np.ptp(by_term), np.mean([scores[1000 + k].predicted for k in range(300)])
    print(found)
    (wrong0, spread0, _), (wrong, spread, caught) = found.values()
    assert wrong0 > 0.1 and wrong <= wrong0 / 4 and spread <= spread0 / 4 and caught >= 0.95


def test_toxicity_counts_features_as_brute_force_does(spark):
    rows = neutral_and_toxic_mentions()[:400]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    learned = [(toxicity.features(t, toxicity.Buckets()), y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    pos, n = sum(y for _, y in learned), len(learned)
    want = set()
    for f in set().union(*(fs for fs, _ in learned)):
        a, both = sum(y for fs, y in learned if f in fs), sum(f in fs for fs, _ in learned)
        cells = [(a, both * pos / n), (both - a, both * (n - pos) / n), (pos - a, (n - both) * pos / n), (n - pos - both + a, (n - both) * (n - pos) / n)]
        if both >= toxicity.LEAST_TEXTS and sum(2 * o * math.log(o / e) for o, e in cells if o) >= toxicity.LEAST_G:
            want.add(f)
    assert want and set(toxicity.fit(docs, labels).weights) == want


def test_toxic_documents_are_found_where_labels_suffice(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [r for r in queries.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic = [r.predicted for r in held if labels[r.doc_id]]
    clean = [r.predicted for r in held if not labels[r.doc_id]]
    print(np.mean(toxic), np.mean(clean), len(toxic))
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02


def test_classifiers_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    stats = quality.all_statistics(docs)
    for model in (quality.fit(stats, labels), quality.fit(stats, labels.limit(0))):
        assert quality.scored(stats, model).filter("score BETWEEN 0 AND 1").count() == len(ROWS)
    for model in (toxicity.fit(docs, labels), toxicity.fit(docs, labels.limit(0))):
        assert toxicity.scored(docs, model).filter("score BETWEEN 0 AND 1").count() == len(ROWS)
        assert toxicity.scored(none, model).count() == 0
    assert quality.all_statistics(none).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(none, labels).count() == 0 and quality.keep_good(docs, labels.limit(0)).count() == 0


def test_quality_filter_takes_columns_of_any_name(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 19)], "doc_id long, quality int")
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("id", "y", "h", "stats", "score", "label", "quality"))])
    plain = Counter(r.doc_id for r in quality.keep_good(docs, labels, 0.4).collect())
    got = quality.keep_good(wide, labels, 0.4)
    assert plain and got.columns == wide.columns and Counter(r.doc_id for r in got.collect()) == plain


def test_toxicity_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    rows = [(k, f"{'moron' if k % 2 else 'nice'} {prose(12)}") for k in range(60)] + [(7, f"moron {prose(12)}") for _ in range(3000)]  # an id of many texts
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    seen = []
    descend = toxicity._descend
    monkeypatch.setattr(toxicity, "_descend", lambda row, col, y, *a: seen.append(len(y)) or descend(row, col, y, *a))
    model = toxicity.fit(docs, labels)
    asked = spark.createDataFrame([(1, "a moron"), (2, "a nice one")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(asked, model).collect()}
    assert seen and seen[0] <= 200 and got[1] > got[2]


def test_identity_terms_are_pulled_together(spark):
    rows, labels = [], []
    for k in range(400):
        toxic = k % 2
        term = "muslim" if toxic and k % 4 == 1 or k % 20 == 0 else "christian"
        rows.append((k, f"{prose(8)}. the {term} family {'moron' if toxic else 'nice'} {prose(5)}."))
        labels.append((k, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    asked = spark.createDataFrame([(1, "a muslim came"), (2, "a christian came"), (3, "a moron came")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(asked, toxicity.fit(docs, labels)).collect()}
    assert abs(got[1] - got[2]) < 0.1 and got[3] > 0.5
    assert toxicity.swaps("The Muslim man. nothing")["muslim", "christian"] == 1


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, steps[-1], SF)
        assert out.columns == docs.columns, name
        steps.append(out.cache())
    good, exact, near, mixed = ([(r.doc_id, r.text) for r in s.collect()] for s in steps[1:])
    groups = defaultdict(list)
    for i, t in good:
        groups[norm(t)].append(i)
    assert Counter(i for i, _ in exact) == Counter(map(min, groups.values()))
    assert Counter(i for i, _ in near) == Counter(set(near_brute_force(exact).values()))
    assert {i for i, _ in mixed} <= {i for i, _ in near}
    packed = corpus_pipeline.STAGES[4][1](spark, steps[4], SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in mixed)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
    for s in steps[1:]:
        s.unpersist()


def test_pipeline_on_odd_and_empty_tables(spark, docs, none, tmp_path, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 19)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("empty", none)):
        table.coalesce(2).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    monkeypatch.setattr(quality, "keep_good", lambda d, _: d)  # all rows go on, odd ones too
    packed = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in packed} <= {i for i, _ in ROWS} and len(packed) > 5
    assert Counter((r.doc_id, r.piece) for r in packed if r.doc_id == 2 or r.doc_id == 3) == {}  # copies of 1
