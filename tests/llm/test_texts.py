"""Operators on document texts against plain versions, on awkward rows."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from vinculo.llm.factor_machine import FactorMachine, FactorRules, Features, fit_factor_machine, score_documents
from vinculo.llm.language import fit_language_model, keep_languages, predict_languages
from vinculo.llm.language import words_of as letters_of
from vinculo.llm.line_rules import LineRules, clean_documents, line_fails, line_verdicts
from vinculo.llm.packing import PackRules, WordIds, best_fit, pack_documents, swap_search
from vinculo.llm.shingle_join import JoinRules, components, least_common, near_duplicates, overlaps, signatures, tau
from vinculo.llm.token_transducer import FIRST, TokenCounter, count_tokens
from vinculo.llm.trie_bpe import TrieCodec, encode_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHING = SCHEMA + ", n_tokens string, id string, n string, token string, bucket string, score string, path string"
PIECES, BYTES, WORDS = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words_of(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def fixture_rows():
    rng = random.Random(3)
    vocabulary = ["the", "and", "thandble", "eredre", "Ölüm", "straße", "漢字", "naïve", "x1", "don't", "a.b", " ", "𝄞"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    texts = [None, "", " \n\t", "one", "one two three four", sentence(9), sentence(40) + "\n" + sentence(12), "word " * 30_000, "x" * 100_000,
             "<|endoftext|> is text <s> too</s>", "a▁b  c   d\n\n e", "HOME | NEWS | ABOUT | CONTACT\n" + sentence(30), "### $$$ %%% &&&\n" * 20]
    base = [rng.choice(vocabulary) + str(rng.randint(0, 400)) for _ in range(200)]
    for k in range(12):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(200)] = f"edit{rng.random()}"
        texts.append(" ".join(near))
    texts += [" ".join(base).upper().lower(), " ".join(base), " ".join(base)]
    passage = " ".join(f"shared{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"own{k}w{j}" for j in range(80)) for k in range(10)]
    rows = [(k, t, "en" if k % 3 else None, f"s{k}", len(t or "")) for k, t in enumerate(texts)]
    return rows + [(None, "a null id with some words in it", "en", None, None), rows[6], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "c", "c", "c", "c", "c", "c", "c") for r in fixture_rows()], CLASHING)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_by_id(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))


def expected_rows():
    return sorted(fixture_rows(), key=lambda r: (r[0] is None, r[0] or 0))


# --- lines -----------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = words_of(text)
    lines = (text or "").split("\n")
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    again = sum(1 for k, x in enumerate(lines) if words_of(x) and x in lines[:k])
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(inside)


def test_line_counts_equal_a_plain_version(docs, nothing):
    found = rows_by_id(line_verdicts(docs))
    for got, row in zip(found, expected_rows(), strict=True):
        want = plain_counts(row[1])
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want, row[0]
        assert got.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got.base_failed and got.kept)
    assert line_verdicts(nothing).collect() == []


def test_each_line_rule():
    rules = LineRules()
    assert line_fails("### $$$ %%% word", rules) == "symbols"
    assert line_fails("home | news | about", rules) == "navigation"
    assert line_fails("THIS IS ALL SHOUTED", rules) == "shouting"
    assert line_fails("the the the the the the the", rules) == "repetition"
    assert line_fails(" ".join(f"w{k}" for k in range(60)), rules) == "punctuation"
    assert line_fails("All rights reserved.", rules) == "boilerplate"
    for good in ("", "   ", "A plain sentence, with some words.", "Von der, enschber einzuie bever dem der ungkeit."):
        assert line_fails(good, rules) is None


def test_cleaning_removes_lines_and_keeps_columns(spark, nothing):
    good = "This is a good line with quite enough words to stay in the text."
    docs = spark.createDataFrame([(1, good + "\nhome | news | about", "en", "s", 0), (2, "home | news | about | this | that | more | less | few | x | y", "en", "s", 0), (3, None, None, None, None)], SCHEMA)
    kept = clean_documents(docs)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, good, "en", "s", len(good))]
    assert clean_documents(nothing).collect() == []


# --- tokens ----------------------------------------------------------------------------------------------------------


def awkward_texts(n):
    rng = random.Random(5)
    letters = "ab cdeéß Ω漢字\n\t.,'s12 \x1c\x85 　<|>▁ ​́𝄞thingerAΣÉ"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_token_counts_equal_the_library(docs, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for got, row in zip(rows_by_id(count_tokens(docs, PIECES, limit=100)), expected_rows(), strict=True):
        n = len(library.encode(row[1] or ""))
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len((row[1] or "").encode()), n, n > 100)
    assert count_tokens(nothing, PIECES).collect() == []


def test_chunk_maps_compose_to_the_whole_text():
    import sentencepiece

    library, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), TokenCounter(PIECES)
    for text in awkward_texts(400):
        for chunk in (1, 2, 3, 7, 1 << 16):
            assert counter.count_text(text, chunk) == len(library.encode(text)), (text, chunk)


def test_trie_ids_and_decoding_equal_the_library(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    for got, row in zip(rows_by_id(encode_documents(docs, BYTES)), expected_rows(), strict=True):
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        assert (got.n_tokens, got.ids, got.decoded) == (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    short = encode_documents(docs.filter("doc_id = 6"), BYTES, digest_only=True).first()
    ids = np.array(library.encode(fixture_rows()[6][1], add_special_tokens=False).ids, np.uint32).tobytes()
    assert short.ids_sha256 == hashlib.sha256(ids).hexdigest() and short.decoded_sha256 == hashlib.sha256(fixture_rows()[6][1].encode()).hexdigest()
    assert encode_documents(nothing, BYTES).collect() == []


def test_trie_words_share_prefixes():
    from tokenizers import Tokenizer

    codec, library = TrieCodec(BYTES), Tokenizer.from_file(BYTES)
    texts = awkward_texts(600) + ["internationalisation internationally international", "\n" * 300, " " * 300]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


# --- packing ---------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_within_capacity(docs, nothing):
    from tokenizers import Tokenizer

    library, rules = Tokenizer.from_file(WORDS), PackRules(capacity=256, group_rows=16)
    rows = pack_documents(docs, WORDS, rules).collect()
    want = Counter()
    for doc, text, *_ in fixture_rows():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        want.update((doc, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.05 * total / 256 + 2
    assert pack_documents(nothing, WORDS, rules).collect() == []


def test_letters_that_composition_takes_apart(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    letters = [chr(c) for c in range(0x80, 0x20000) if chr(c).isalpha() and len(unicodedata.normalize("NFC", chr(c))) > 1]
    assert {"\u0958", "\u09dc", "\u0a33", "\ufb1d"} <= set(letters)
    texts = [f"plain {x}lam and a{x} {x}, here {x}{x}" for x in letters]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, np.uint32).tobytes() for x in texts]
    assert WordIds(WORDS).encode_all(texts) == want
    # Words that are taken for letters although the library parts them.
    monkeypatch.setattr("vinculo.llm.packing._letters", lambda word: True)
    assert WordIds(WORDS).encode_all(texts) == want


def test_swaps_empty_bins_that_best_fit_leaves():
    lengths, bins = [6, 3, 5, 4, 2], [[0, 1], [2, 3], [4]]
    better = swap_search(lengths, [list(b) for b in bins], 10)
    assert len(better) == 2 and sorted(sum(better, [])) == [0, 1, 2, 3, 4]
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        first = best_fit(lengths, 100)
        after = swap_search(lengths, [list(b) for b in first], 100)
        assert sorted(sum(after, [])) == list(range(len(lengths))) and len(after) <= len(first)
        assert all(sum(lengths[i] for i in b) <= 100 for b in after)


# --- near duplicates -------------------------------------------------------------------------------------------------


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def plain_components(rows):
    sets = {doc: shingles(text) for doc, text, *_ in rows if doc is not None}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                a_, b_ = sorted((find(a), find(b)))
                parent[b_] = a_
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_components_equal_all_pairs(docs, nothing):
    want = plain_components(fixture_rows())
    for rules in (JoinRules(), JoinRules(singles=1, pairs=2, share=0.1, hub_rounds=1), JoinRules(hub_rounds=0, share=1.0, cell_ids=3, cell_postings=40)):
        rows = rows_by_id(near_duplicates(docs, rules))
        assert len(rows) == len(fixture_rows())
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
        assert [tuple(r) for r in rows if r.doc_id is None] == [(None, 4, None)]
    assert near_duplicates(nothing).collect() == []


def overlapping_lists(seed):
    """Sets of words: linked pairs whose two rarest common words each stand in five other sets, which link with nothing."""
    rng = random.Random(seed)
    rows = []
    for block in range(4):
        core, filler = [f"w{block}x{k}" for k in range(9)], [f"f{block}y{k}" for k in range(90)]
        sets = [[*core, f"x{block}"], [*core, f"y{block}"]]
        sets += [[core[k % 2], *filler[9 * k : 9 * k + 9]] for k in range(10)]
        # All other words are in more sets than the two rare ones.
        sets += [[*core[2:], f"g{block}z{j}"] for j in range(8)]
        sets += [[filler[k], filler[(k + d) % 90]] for k in range(90) for d in (10, 20, 30, 40)]
        rows += [(1000 * block + i, " ".join(x)) for i, x in zip(rng.sample(range(1000), len(sets)), sets, strict=True)]
    return rows


def test_common_signatures_are_counted_over_all_lists(spark):
    for seed, hubs in ((0, 0), (1, 0), (0, 1)):
        rows = overlapping_lists(seed)
        sets = {doc: frozenset(text.split()) for doc, text in rows}
        want, ids = {d: d for d in sets}, sorted(sets)
        for k, b in enumerate(ids):
            for a in ids[:k]:
                shared = len(sets[a] & sets[b])
                if shared and overlaps(len(sets[a]), len(sets[b]), shared):
                    x, y = sorted((want[a], want[b]))
                    want = {d: x if c == y else c for d, c in want.items()}
        assert sum(d != c for d, c in want.items()) == 4
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in near_duplicates(docs, JoinRules(words=1, hub_rounds=hubs, share=1.0)).collect()}
        assert found == want, (seed, hubs)


def test_linked_sets_always_share_a_signature():
    rng = random.Random(2)
    for _ in range(1500):
        n = rng.choice([1, 2, 5, 8, 9, 16, 31, 33, 60, 130, 260])
        a = rng.sample(range(10 * n + 10), n)
        b = list(a)
        for _ in range(rng.randint(0, max(1, n // 8))):
            if rng.random() < 0.5 and len(b) > 1:
                b.pop(rng.randrange(len(b)))
            else:
                b.append(10 * n + 10 + rng.randrange(50))
        b = list(set(b))
        df = {t: rng.choice([2, 3, 5, 9, 20, 70, 500]) for t in {*a, *b}}
        alone = set(a) ^ set(b)
        df |= {t: 1 for t in alone if rng.random() < 0.5}
        rules = JoinRules(singles=rng.choice([1, 8]), pairs=64)
        shared = len(set(a) & set(b))
        if overlaps(len(a), len(b), shared):
            one, other = (signatures(len(x), [(df[t], t) for t in x if df[t] > 1], rules) for x in (a, b))
            assert len(one & other) >= least_common(len(a), len(b)), (a, b)
        assert tau(n) == n - -(-80 * n // 100)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (300, 301), (300, 301)]
    for together in (1000, 0):
        found = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long"), together).collect()}
        assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 150)} | {301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- learning --------------------------------------------------------------------------------------------------------


def test_languages_are_told_by_words_and_by_grams(spark, nothing):
    texts = {"en": "the house and the garden with the old tree", "de": "das haus und der garten mit dem alten baum", "fr": "la maison et le jardin avec le vieil arbre"}
    docs = spark.createDataFrame([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(list(texts.items()) * 5)] + [(90, "xyz", None, "s", 0), (91, None, "de", "s", 0)], SCHEMA)
    model = fit_language_model(docs)
    assert model.languages == ["de", "en", "fr"]
    asked = [(1, "the garden", "und"), (2, "gartenhaus und bäume", "x"), (3, "jardinet maisonnette", None), (4, None, "en"), (5, "123 !!", "en"), (6, "", "en"), (None, "le jardin", None)]
    found = {r.doc_id: r for r in predict_languages(spark.createDataFrame(asked, "doc_id long, text string, score string"), model).collect()}
    assert {k: r.lang_pred for k, r in found.items()} == {1: "en", 2: "de", 3: "fr", 4: "und", 5: "und", 6: "und", None: "fr"}
    assert all(0 <= r.score <= 1 for r in found.values()) and found[4].score == 0
    assert keep_languages(docs, model).filter("doc_id = 91").collect() == []
    assert {r.lang_pred for r in predict_languages(docs, fit_language_model(nothing)).collect()} == {"und"}


def test_factor_machine_score_is_the_sum_over_pairs(spark, nothing):
    import pyarrow as pa

    rules = FactorRules(bits=6, factors=3)
    rng = np.random.default_rng(1)
    size = (1 << rules.bits) + 400
    model = FactorMachine(0.3, rng.normal(size=size), rng.normal(size=(size, 3)), rules)
    made = Features(pa.array(["some words, and some more", None, "", "AGAIN | again"]), rules)
    got = model.logits(made.index, made.value, made.bounds)
    for t in range(4):
        i, x = (v[made.bounds[t] : made.bounds[t + 1]] for v in (made.index, made.value))
        assert len(set(i)) == len(i)
        pairs = sum((model.factors[i[a]] @ model.factors[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got[t] == pytest.approx(0.3 + model.weights[i] @ x + pairs, rel=1e-4)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a good text", None, None, None), (2, "### $$$", None, None, None), (3, None, None, None, None)], SCHEMA)
    fitted = fit_factor_machine(docs, labels, rules)
    scores = {r.doc_id: r.score for r in score_documents(docs, fitted).collect()}
    assert set(scores) == {1, 2, 3} and scores[1] > scores[2]
    assert score_documents(nothing, fit_factor_machine(nothing, labels, rules)).collect() == []


def test_texts_without_a_space_are_counted_in_chunks():
    import sentencepiece

    rng = random.Random(8)
    library, counter = sentencepiece.SentencePieceProcessor(model_file=PIECES), TokenCounter(PIECES)
    for signs, n in (("aeinrst", 300_000), ("中文字日本語", 300_000), ("ab", 1_000_000), (" ", 200_000)):
        text = "".join(rng.choice(signs) for _ in range(n))
        assert counter.count_text(text) == len(library.encode(text)), signs


def test_a_chunk_maps_states_to_states_and_counts():
    counter = TokenCounter(PIECES)
    text = " strengthening the internationalisation ofunspacedlongwordsthatgoonandon 中文字日本語中文字"
    for cut in range(1, len(text)):
        first, second = counter.chunk_maps(text, cut)[:2]
        entry, tokens = first(FIRST)
        # The state that the first chunk ends in is among those that the second one was read from.
        assert entry in second.held
        assert counter.machine.run(FIRST, text[: 2 * cut].replace(" ", "▁"))[1] == tokens + second(entry)[1]
    # Behind a border all entry states come to one.
    whole = counter.chunk_maps("ab cd", 5)[0]
    states = {counter.machine.run(FIRST, x)[0] for x in ("▁inter", "▁x", "中", "")}
    assert len(states) > 1 and len({whole(s)[0] for s in states}) == 1


def test_number_signs_are_no_letters(spark):
    assert letters_of("½ ² ① Ⅷ x²y Été 一 3a") == ["x", "y", "été", "一", "a"]


def test_a_repeated_id_teaches_once(spark):
    rows = [(i, f"word{i % 7} some text of row {i}", None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = spark.createDataFrame(rows + [rows[3]] * 500 + [(4, "zzz later text", None)], "doc_id long, text string, lang string")
    a, b = fit_factor_machine(once, labels), fit_factor_machine(often, labels)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.factors, b.factors) and a.bias == b.bias
