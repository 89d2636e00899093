"""Order-preserving packing, source divergence and hard negatives against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from vinculo.llm.multi_index import MineRules, mine_negatives
from vinculo.llm.source_audit import AuditRules, source_divergence, split_terms
from vinculo.llm.window_cuts import CutRules, best_cuts, window_pieces

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, term string, n long, start string, sequence_id string"


def doc(k, text, lang="en", source="s"):
    return (k, text, lang, source, "t", 7, "x", "y")


# --- op11 ------------------------------------------------------------------------------------------------------------


def plain_cost(places, costs, cuts, capacity, window):
    total, before = 0, 0
    for j in cuts:
        size = places[j] - places[before]
        assert 0 < size <= capacity
        total += costs[j] + window + (0 if size & (size - 1) == 0 else capacity - size)
        before = j
    assert before == len(places) - 1
    return total


def test_cuts_cost_what_the_plain_recurrence_says():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([8, 16, 64])
        places = [0]
        while len(places) < 60:
            places.append(places[-1] + rng.randint(1, capacity))
        costs = [0, *(rng.choice([0, 3, 9]) for _ in places[1:])]
        window = rng.choice([0, 1, 4])
        least = [0.0] * len(places)
        for j in range(1, len(places)):
            least[j] = min(
                least[i] + costs[j] + window + (0 if (d := places[j] - places[i]) & (d - 1) == 0 else capacity - d)
                for i in range(j) if places[j] - places[i] <= capacity
            )
        assert plain_cost(places, costs, best_cuts(np.array(places), costs, capacity, window), capacity, window) == least[-1]


def stream_rows():
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "ε", "3.14"]) for _ in range(rng.randint(3, 20))) + rng.choice([". ", "! ", '." ', "\n"])
    rows = [doc(k, "".join(sentence() for _ in range(rng.randint(1, 60)))) for k in range(150)]
    rows += [doc(200, None), doc(201, ""), doc(202, " \n"), doc(203, "word " * 30_000), doc(204, "<|endoftext|> is text."), doc(None, "No id. Two sentences.")]
    return rows + [rows[3], rows[3]]


def test_windows_hold_the_stream_in_its_order(spark):
    rows, rules = stream_rows(), CutRules()
    found = window_pieces(spark.createDataFrame(rows, DOCS).coalesce(1), WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    ids = [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, rules.end], np.uint32) for r in rows]
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append(r)
    stream = [p for s in sorted(windows) for p in sorted(windows[s], key=lambda r: r.offset)]
    at, each, fills = 0, 0, []
    for s in sorted(windows):
        fill = 0
        for p in sorted(windows[s], key=lambda r: r.offset):
            assert p.offset == fill
            fill += p.length
        fills.append(fill)
    assert max(fills) <= rules.capacity
    # Pieces follow each other in the order of rows; together they are every document's ids, once.
    for p in stream:
        own = ids[each]
        assert (p.doc_id, p.start, p.doc_tokens) == (rows[each][0], at, len(own))
        assert p.ids_crc32 == zlib.crc32(own[at : at + p.length].tobytes())
        at += p.length
        if at == len(own):
            each, at = each + 1, 0
    assert each == len(rows)
    padding = sum(0 if f & (f - 1) == 0 else rules.capacity - f for f in fills[:-1])
    assert padding <= 0.005 * sum(fills)
    # Cuts inside documents stand behind sentences, but for the text that has none.
    stops = {library.token_to_id(t) for t in (".</w>", "!</w>", '."</w>', '"</w>')}
    inner = [(p, ids[k]) for p in found for k in range(len(rows)) if rows[k][0] == p.doc_id and p.start and p.doc_id not in (203, None)]
    assert sum(int(own[p.start - 1]) in stops for p, own in inner) >= 0.8 * len(inner)


def test_streams_of_partitions_orders_and_nothing(spark):
    docs = spark.createDataFrame(stream_rows(), DOCS).repartition(5)
    found = window_pieces(docs, WORDS, order=["doc_id"]).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    firsts = [r.doc_id for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0 and r.doc_id is not None]
    assert firsts == sorted(firsts)
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    small = window_pieces(docs, WORDS, CutRules(capacity=64, stretch=32, grid=8)).collect()
    fill = Counter()
    for r in small:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 64 and sum(fill.values()) == sum(r.length for r in found)
    assert window_pieces(spark.createDataFrame([], DOCS), WORDS).collect() == []


# --- op12 ------------------------------------------------------------------------------------------------------------


def plain_divergence(rows, rules):
    per_lang, groups, docs_of = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        groups[lang, source].update(terms)
        per_lang[lang].update(terms)
        docs_of[lang].update(set(terms))
    out = set()
    for lang in per_lang:
        kept = [t for t, n in docs_of[lang].items() if n >= rules.least_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + rules.scale * (counts[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: shares(c) for (x, s), c in groups.items() if x == lang}
        q = shares(per_lang[lang])
        for s, p in own.items():
            pairs = [(sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x) for x, o in own.items() if x != s]
            terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if groups[lang, s][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, rules.terms)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda v: (-v[0], v[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def audit_rows():
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Ölüm", "漢字", "naïve", "don't", "ÄB", "𝄞x"]
    rows = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else f"s{rng.randint(0, 11)}"
        words = [vocabulary[min(int(rng.expovariate(0.05)) + (len(source) * 3 if source != "hot" else 0), len(vocabulary) - 1)] for _ in range(rng.randint(0, 40))]
        rows.append(doc(k, " ".join(words), rng.choice(["en", "en", "de"]), source))
    rows += [doc(500, None, "en", "silent"), doc(501, "1 2 3 _", "en", None), doc(502, "alone", "fr", "a"), doc(503, "other", "fr", "b"), doc(504, "x", "it", "only"),
             doc(505, "wa " * 20_000, None, "long"), doc(506, "WAA waa", None, None), doc(507, "a" * 70_000, None, "s"), (None, "wab wac", "en", "hot", "t", 1, "", "")]
    return rows + [rows[5]] * 3 + [doc(600 + k, "tie tied", "xx", f"t{k}") for k in range(4)]


@pytest.mark.parametrize("rules", [AuditRules(), AuditRules(terms=7, held=50, bucket_rows=60, block=3)])
def test_divergence_is_exact(spark, rules):
    rows = audit_rows()
    found = source_divergence(spark.createDataFrame(rows, DOCS).repartition(3), rules).select("lang", "source", "part", "item", "value", "rank").collect()
    want = plain_divergence(rows, rules)
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_terms_and_empty_audit(spark):
    assert split_terms("Don't STOP,ÄÖ\x1f漢字9x_") == [b"don", b"t", b"stop", "ÄÖ".encode(), "漢字".encode(), b"x"]
    assert source_divergence(spark.createDataFrame([], DOCS)).collect() == []


# --- op13 ------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string, cell string, x string"


def plain_negatives(rows, rules):
    good = [(i, lab, [int(np.floor(rules.scale * float(np.float32(v)))) for v in e]) for i, e, lab, *_ in rows
            if i is not None and lab is not None and e and all(v is not None and np.isfinite(v) for v in e)]
    out = Counter()
    for a, (i, label, x) in enumerate(good):
        if i % rules.anchor_every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=True)), j, lab) for b, (j, lab, y) in enumerate(good) if b != a and len(y) == len(x)))
        positives = [(-s, j) for s, j, lab in scored if lab == label][: rules.positives]
        for p, pid in positives:
            negatives = [(-s, j) for s, j, lab in scored if lab != label and rules.low_percent * p <= 100 * -s <= 100 * p][: rules.negatives]
            for rank, (n, nid) in enumerate(negatives, 1):
                out[i, pid, rank, nid, p, n] += 1
    return out


def mining_rows(clusters):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 10)) * (3 if clusters else 0)
    rows = []
    for k in range(1500):
        c = k % 9
        rows.append((k, (centres[c] + rng.normal(size=10) * 0.4).tolist(), int(rng.integers(0, 3)) if k % 5 else c % 3, "r", "c", "x"))
    tie = [1.0] * 10
    rows += [(2000 + k, tie, k % 2, "r", "c", "x") for k in range(30)]
    inf, nan = float("inf"), float("nan")
    rows += [(3000, None, 1, "", "", ""), (3100, [1.0] * 9 + [None], 1, "", "", ""), (3200, [nan] * 10, 1, "", "", ""), (3300, [inf] * 10, 1, "", "", ""), (3400, tie, None, "", "", ""),
             (3500, [], 1, "", "", ""), (None, tie, 1, "", "", ""), (3600, [0.5, 2.0], 0, "", "", ""), (3601, [0.5, 1.9], 0, "", "", ""), (3602, [0.5, 1.8], 1, "", "", ""), (3700, [0.0] * 10, 1, "", "", "")]
    return rows


@pytest.mark.parametrize(("clusters", "rules"), list(product([False, True], [MineRules(), MineRules(anchor_every=50, cell_rows=16, shard=100, block=7, first_rows=40, sample=200)])))
def test_negatives_are_exact(spark, clusters, rules):
    rows = mining_rows(clusters)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    found = mine_negatives(spark.createDataFrame(rows, VECTORS).repartition(4), rules).select(*columns).collect()
    assert Counter(tuple(r) for r in found) == plain_negatives(rows, rules)


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0], 1, "", "", ""), (1, [1.0, 0.1], 1, "", "", ""), (2, [0.9, 0.0], 2, "", "", "")]
    (one,) = mine_negatives(spark.createDataFrame(rows, VECTORS)).collect()
    assert (one.anchor_id, one.positive_id, one.rank, one.negative_id) == (0, 1, 1, 2)
    # Equal rows are rows of their own.
    twice = [rows[0], rows[0], (5, [1.0, 0.0], 2, "", "", "")]
    assert len(mine_negatives(spark.createDataFrame(twice, VECTORS)).collect()) == 2
    assert mine_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def test_walk_is_best_first_and_complete():
    from vinculo.llm.multi_index import Directory, codebook

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)) * 50
    books = (codebook(x[:500, :4], 12), codebook(x[:500, 4:], 12))
    none = np.zeros(0, int)
    cell, away = Directory(books, none, none, np.zeros((0, 2)), none, none).cells_of(x)
    cells, at, n = np.unique(cell, return_inverse=True, return_counts=True)
    radii = np.stack([[away[at == k, h].max() for k in range(len(cells))] for h in (0, 1)], axis=1)
    found = Directory(books, cells, n, radii, none, none)
    for q in x[:20]:
        steps = list(found.walk(q))
        assert sorted(s[1] for s in steps) == list(range(len(cells)))
        assert all(a[0] >= b[0] - 1e-6 for a, b in zip(steps, steps[1:], strict=False))
        for bound, place, upper, lower in steps:
            scores = x[at == place] @ q
            assert lower <= scores.min() and scores.max() <= upper <= bound + 1e-3


def test_words_of_all_kinds_are_learnt_as_the_library_has_them():
    """One reader serves all tasks of a worker, with the vocabulary's sentence ends found once."""
    from vinculo.llm.window_cuts import _reader

    words, sentence_ends = _reader(WORDS)
    library = Tokenizer.from_file(WORDS)
    texts = ["Plain words, PLAIN Words; plain!", "Straße ǅ ﬁne İstanbul ȧ̈ naïve.", "a1 b_2 $5.00 (x) \"end.\" ...", "", "plain 中文。 words\nnext words ,,", None] * 2
    for _ in range(2):
        got = [np.frombuffer(raw, np.uint32).tolist() for raw in words.encode_all(texts)]
        assert got == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    ids = np.array(library.encode("one. two 3 .", add_special_tokens=False).ids, np.uint32)
    assert sentence_ends.after(ids).size >= 1
