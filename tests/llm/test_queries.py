"""The corpus queries against DuckDB or brute force over the smallest tables."""

import zlib

import numpy as np
import pandas as pd
import pytest

from kinfold.llm import bpe, langid, queries
from kinfold.llm.oracle import ORACLES
from tests.compare import same


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    made = {}

    def get(name):
        if name not in made:
            made[name] = queries.queries()[name](spark, sf_dir).toPandas()
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf_dir, duck, name):
    same(queries.queries()[name](spark, sf_dir), duck, ORACLES[name])


def union_find(n, pairs):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not own:
        return 0
    grams = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes_match_all_pairs(docs, results):
    got = results("op5_simhash_near_dedup").sort_values("doc_id").reset_index(drop=True)
    own = docs.sort_values("doc_id").reset_index(drop=True)
    fp = [brute_fingerprint(t) for t in own.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fp]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    assert pairs
    assert got.component_id.tolist() == [own.doc_id[i] for i in union_find(len(fp), pairs)]


def test_token_counts_match_the_library(docs, results):
    enc = bpe.encoder(bpe.default_path("byte_bpe_50k.json")).library
    got = results("op7_token_counts").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        n = len(enc.encode(text or "", add_special_tokens=False).ids)
        assert got.n_tokens[i] == n and got.over_limit[i] == (n > 1024) and got.n_bytes[i] == len((text or "").encode())


def test_packing_places_every_id_once(docs, results):
    enc = bpe.encoder(bpe.default_path("byte_bpe_50k.json")).library
    got = results("op8_packing")
    for i, text in zip(docs.doc_id, docs.text):
        ids = np.array(enc.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes.sort_index().iloc[:-1] == 1024).all() and sizes.max() <= 1024


def test_binary_files_round_trip(docs, results):
    enc = bpe.encoder(bpe.default_path("word_bpe_49k.json")).library
    got = results("op10_token_binary").set_index("doc_id")
    at = 0
    for i, text in sorted(zip(docs.doc_id, docs.text)):
        ids = np.array(enc.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got.start[i], got.n_tokens[i], got.ids_crc32[i]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_classifier_on_held_out_labels(sf_dir, results):
    got = results("op3_quality_classifier")
    assert got.held_out.tolist() == [held_out(i) for i in got.doc_id]
    assert got.score.between(0, 1).all()
    judged = got[got.held_out].merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert (judged.predicted == judged.quality).mean() >= 0.8


def test_language_on_held_out_documents(docs, results):
    got = results("op4_language_id").merge(docs, on="doc_id")
    assert got.held_out.tolist() == [held_out(i) for i in got.doc_id]
    long = got[got.held_out & (got.n_chars > 50)]
    assert (long.lang == long.lang_pred).mean() >= 0.95


def test_pseudonyms_hide_values_and_leave_the_rest(docs, results):
    import re

    got = results("op2_pii").merge(docs, on="doc_id", suffixes=("", "_was"))
    values = re.compile(r"[\w.]+@[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|AKIA\w{16}|password=\w+|token = \"\w+\"")
    n = 0
    for r in got.itertuples():
        for v in values.findall(r.text_was):
            decoy = v.isdigit() and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(v))) % 10
            assert (v in r.text) == bool(decoy)
            n += 1
        if r.n_pii == 0:
            assert r.text == r.text_was
    assert n


def cut_passages(text, wins):
    """The text without benchmark passages, and whether over half of its words are in them."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    places = [(m.span(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    own = [w for _, w in places]
    hit = {k + j for n in {len(x) for x in wins} for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in wins for j in range(n)}
    for k in sorted(hit, reverse=True):
        if k + 1 not in hit:
            end = places[k][0][1]
        if k - 1 not in hit:
            text = text[: places[k][0][0]] + text[end:]
    return text, len(hit) > 0.5 * len(own), bool(hit)


def test_pipeline_matches_brute_force(spark, sf_dir, duck, docs):
    """Every stage done again, document by document: stage one by its SQL, the others here."""
    import re

    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    judged = duck.sql(ORACLES["op1_quality_rules"]).df()
    judged = judged[judged.kept].merge(docs[["doc_id", "source"]], on="doc_id").sort_values("doc_id")
    blank = " \t\n\x0b\x0c\r"
    sites, copies, first = {}, {}, {}
    for r in judged.itertuples():
        for line in {x.strip(blank) for x in r.clean_text.split("\n")} - {""}:
            sites.setdefault(line, set()).add(r.source)
            copies.setdefault(line, set()).add(r.clean_text)
            first.setdefault(line, r.doc_id)
    texts = {}
    for r in judged.itertuples():
        seen, out = set(), []
        for line in r.clean_text.split("\n"):
            s = line.strip(blank)
            if s and len(sites[s]) >= 10 and len(copies[s]) >= 10:
                if first[s] != r.doc_id or s in seen:
                    continue
                seen.add(s)
            out.append(line)
        texts[r.doc_id] = "\n".join(out)
    ids, sets = list(texts), []
    for i in ids:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    tops = union_find(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])])
    texts = {ids[i]: texts[ids[i]] for i in range(len(ids)) if tops[i] == i}
    wins = set()
    for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    enc = bpe.encoder(bpe.default_path("byte_bpe_50k.json")).library
    want, n_cut = {}, 0
    for i, t in texts.items():
        t, gone, cut = cut_passages(t, wins)
        n_cut += cut
        if not gone:
            want[i] = np.array(enc.encode(t, add_special_tokens=False).ids + [0], "<u4")
    assert n_cut and len(judged) < len(docs) and len(ids) > len(texts)
    assert set(got.doc_id) == set(want)
    for i, p in got.groupby("doc_id"):
        at = 0
        for r in p.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(want[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[i])


def brute_phrases(text, sample):
    n, cur = 1, ""
    for c in text:
        if cur + c in sample:
            cur += c
        else:
            n += 1
            cur = c if c in sample else ""
    return n


def test_automaton_finds_the_longest_phrases():
    sample = "the cat sat on the mat and the cat ran"
    a = langid.Automaton(sample)
    for probe in (" the cat", " mat ran xx", " on on on", "zzz", "tttt", "hecatsat"):
        assert a.phrases(probe) == brute_phrases(probe, sample)


def test_language_matches_a_plain_parse(spark, sf_dir, docs, results):
    """The whole query against a parse by substring search, given the words learned."""
    sample = langid.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    assert set(sample) == set(docs.lang.dropna())
    seen = {w for i, t, k in zip(docs.doc_id, docs.text, docs.lang) if not held_out(i) and t and k for w in plain_words(t)}
    assert all(set(v.split()[:-1]) <= seen and len(v) <= langid.SAMPLE_CHARS for v in sample.values())
    known = {}

    def cost(w, k):
        if (w, k) not in known:
            known[w, k] = brute_phrases(f" {w} ", f" {sample[k]} ")
        return known[w, k]

    got = results("op4_language_id").set_index("doc_id").lang_pred
    for i, text in zip(docs.doc_id, docs.text):
        own = plain_words(text or "")
        assert got[i] == (min(sorted(sample), key=lambda k: sum(cost(w, k) for w in own)) if own else "und")


def plain_words(text):
    import regex

    return regex.findall(r"\p{L}+", text.lower())


def test_texts_without_a_letter_are_undetermined(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["½ ²", "①②③", "٣٤", "__ 12", "\u0301", "x²", "日本"])], "doc_id long, text string")
    got = [r["lang_pred"] for r in langid.predict(docs, {"a": "the cat", "b": "le chat"}).orderBy("doc_id").collect()]
    assert [p == "und" for p in got] == [True] * 5 + [False] * 2


def test_learning_does_not_depend_on_order(spark):
    rows = [(None, "one two three", "en"), (None, "four five six", "en"), (1, "eins zwei", "de"), (1, "drei vier", "de"), (1, "drei vier", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = langid.learn(df)
    assert want == langid.learn(spark.createDataFrame(rows[::-1], df.schema).repartition(3)) == {"en": "five four one six three two", "de": "drei vier eins zwei"}


def test_remembered_words_count_as_fresh_ones(monkeypatch):
    sample = {"a": "the cat sat on the mat", "b": "le chat est sur la table"}
    own = langid.normalise("The chat sat sur the mat; le mat, zut " + "x" * 100) * 3
    want = [sum(brute_phrases(f" {w} ", " " + sample[k] + " ") for w in own) for k in "ab"]
    for room in (langid.CELLS, 6):
        monkeypatch.setattr(langid, "CELLS", room)
        parser = langid.Parser(sample)
        for _ in range(2):
            assert parser.phrases(own).tolist() == want
