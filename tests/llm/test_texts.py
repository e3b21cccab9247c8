"""Quality rules, chat templates, toxicity and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, quality, toxicity
from tidemark.llm.common import Scratch
from tidemark.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows, want = QUERIES[name](spark, DATA), db.sql(ORACLES[name])
    assert rows.columns == list(want.columns)
    assert Counter(map(tuple, rows.collect())) == Counter(want.fetchall())


# ---------------------------------------------------------------- quality


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    repeated = set()
    for i in range(len(words) - 2):
        if any(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2) if j != i):
            repeated |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", line) and line in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#\x1cé\xa0"), max_size=50))
def test_base_counts(text):
    assert tuple(quality.base_counts(text)[0]) == brute_base(text)


def test_js_distance():
    p = np.array([1, 0]), np.array([0, 1])
    assert quality.js_distance(*p) == 1
    assert quality.js_distance(p[0], p[0]) == 0
    assert quality.js_distance(np.array([0, 0]), p[0]) == 0
    assert quality.js_distance(np.array([3, 1]), np.array([1, 1])) == pytest.approx(math.sqrt(0.5 * (0.75 * math.log2(0.75 / 0.625) + 0.25 * math.log2(0.25 / 0.375)) + 0.5 * (0.5 * math.log2(0.5 / 0.625) + 0.5 * math.log2(0.5 / 0.375))))


def test_quality_rules(spark):
    rng = np.random.default_rng(1)
    common = "the of and to in it is on that for".split()
    prose = lambda n: " ".join(f"{rng.choice(common)} {''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(n)) + "."
    rows = [(i, prose(60), "en") for i in range(30)]
    rows += [(100, prose(60).replace(" ", "###$$|% "), "en"), (101, prose(60).upper() + "!" * 40, "en"), (102, None, "en"), (103, "", None), (104, "word " * 80, "en"), (105, prose(60), None), (None, prose(60), "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash")).withColumn("c0", F.lit("stays"))
    got = quality.quality_rules(df, quality.references(df))
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].kept for i in [*range(30), 105, None])
    assert not any(by[i].kept for i in (100, 101, 102, 103, 104))
    assert [by[i].base_failed for i in (100, 101, 102, 103, 104)] == [False, False, True, True, True]
    assert by[0].c0 == "stays"
    for r in rows:
        assert tuple(by[r[0]][f] for f in quality.Base._fields) == brute_base(r[1] or "")
    empty = df.limit(0)
    assert quality.quality_rules(empty, quality.references(empty)).count() == 0


def test_references_count_all_texts(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = quality.references(df)
    words = Counter(quality.common_form(w) for r in df.collect() if r.lang == "en" for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    total = sum(words.values())
    del words[""]
    best = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]
    assert got["en"].words == {w: k for k, (w, _) in enumerate(best)}
    assert got["en"].counts == (*[n for _, n in best], total - sum(n for _, n in best))


def test_limits_come_from_the_distances_of_a_language(spark):
    """Long texts without the language's common words go under measured limits, though 0.46 keeps them."""
    rng = np.random.default_rng(2)
    common = "the of and to in it is on that for".split()
    rare = ["".join(w) for w in rng.choice(list("abcdefgh"), (400, 5))]
    prose = lambda n: " ".join(f"{rng.choice(common)} {rng.choice(rare)} {rng.choice(rare)} {rng.choice(rare)}" for _ in range(n)) + "."
    rows = [(i, prose(100), "en") for i in range(300)] + [(1000 + i, " ".join(rng.choice(rare, 400)), "en") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = quality.references(df, least_texts=100)
    kept = lambda reference: {r.doc_id for r in quality.quality_rules(df, reference).where("kept").collect()}
    assert kept(plain) == {r[0] for r in rows}
    assert kept(quality.measured_limits(df, plain)) == set(range(300))


def test_small_share_has_a_reference_of_its_own(spark):
    """Texts in another script pass when there are enough to speak for the language, and when nothing speaks for it."""
    rng = np.random.default_rng(1)
    prose = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n)) + "."
    latin = [(i, prose("abcdefgh", 60), "en") for i in range(30)]
    rows = [(100, prose("абвгдежз", 60), "ru"), (101, prose("абвгдежз", 60), "ru"), (102, prose("αβγδεζηθ", 60), "el"), (103, prose("абвгдежз", 60), None)]
    df = spark.createDataFrame(latin + rows, "doc_id long, text string, lang string")
    reference = quality.references(df, least_texts=2)
    assert set(reference) == {"en", "ru"}
    got = {r.doc_id: r.kept for r in quality.quality_rules(df, quality.measured_limits(df, reference)).collect()}
    assert all(got.values())
    crowd = quality.references(df.where("lang = 'en'"))
    assert not any(r.kept for r in quality.quality_rules(df.where("doc_id >= 100"), {None: crowd[None]}).collect())


# ---------------------------------------------------------------- chat


def rendered(template, **names):
    return "".join(t for t, _ in chat.compile_template(template)(names))


@pytest.mark.parametrize(
    "template, want",
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"),
        ("{{ x.y['z'] | upper ~ '!' }}", "Q!"),
        ("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "1a,2b"),
        ("{% if n > 3 %}x{% elif n == 3 %}y{% else %}z{% endif %}", "y"),
        ("{%- set k = n - 1 -%}  {{ k if k < 3 else 'big' }}", "2"),
        ("{# no #}{{ nothing | default('d') }}{{ 'a' in xs and 'b' not in ['c'] }}" if False else "{{ nothing | default('d') }}{{ 'a' in xs }}", "dtrue"),
        ("{{ \"q\\n\" | trim }}{{ -n }}{{ xs | length }}", "q-32"),
    ],
)
def test_templates(template, want):
    assert rendered(template, x={"y": {"z": "q"}}, xs=["a", "b"], n=3) == want


@pytest.mark.parametrize("template", ["{{ x.__class__ }}", "{{ f() }}", "{{ x | eval }}", "{{ _x }}", "{% import os %}", "{% if x %}", "{{ 1 + }}", "{{ 'a' * 9 }}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}"])
def test_sandbox(template):
    with pytest.raises(chat.TemplateError):
        rendered(template, x="s")


def test_constants_are_folded():
    tree = chat.fold(chat.parse("{% if 1 < 2 %}a{{ 'b' | upper }}{% else %}{{ x }}{% endif %}c"))
    assert tree == (chat.Output(chat.Const("aBc")),)


NASTY = st.text(st.sampled_from(["\\", "<", "[", "s>", "/s>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "[/INST]", "\n", "a", " "]), max_size=12).map(str)
PIECES = st.lists(st.sampled_from(["\\", "<", "[", "s>", "/s>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "[/INST]", "\n", "a", " "]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), max_size=4), st.integers(1, 40))
def test_output_reads_back(turns, part):
    pieces = list(chat.compile_template(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]}))
    whole = "".join(p for p, _ in pieces)
    assert list(chat.read_turns(whole[i : i + part] for i in range(0, len(whole), part))) == turns
    assert [chat.unescape(p) for p, generated in pieces if generated] == [t for r, t in turns if r == "assistant" and t]
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
        assert chat.unescape(chat.escape(text)) == text


@pytest.mark.parametrize("part_chars", [1 << 20, 30])
def test_conversations(spark, part_chars):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "ok?"), (2, 0, None, None), (2, None, "system", "first"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} \\ [INST]") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("clash"), "spans": F.lit(0)})
    got = {r.conv_id: r for r in chat.digests_of_output(chat.format_conversations(df, part_chars=part_chars)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests_of_output(chat.format_conversations(df.limit(0))).count() == 0


# ---------------------------------------------------------------- toxicity


def labelled(n=600, seed=3):
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.integers(20, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for k in rng.integers(0, len(words), 1 + len(words) // 25):
                words[k] = str(rng.choice(["wretchling", "gutterspawn", "foulbrow"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (None, ""), (9001, "x" * 50_000), (0, rows[0][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9000, None), (9002, 1), (3, 1 - rows[3][2])], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    for r in scored:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    test = [(truth[r.doc_id], r.score >= 0.5) for r in scored if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in test]) >= 0.95
    assert all(r.score < 0.5 for r in scored if r.doc_id in (9000, None))


@pytest.mark.parametrize("rows, score", [([], 0.001), ([(1, 1)], 0.999), ([(1, 0), (2, 0)], 0.001)])
def test_labels_of_one_kind(spark, rows, score):
    docs = spark.createDataFrame([(1, "a text"), (2, "another text")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    want = {0.001: 0.001, 0.999: 0.999}[score]
    assert all(r.score == pytest.approx(want, abs=1e-6) for r in toxicity.score_documents(docs, model).collect())


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == corpus_pipeline.COLUMNS, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        assert after.count() > 0.5 * before.count(), name
        before = after
    packed = corpus_pipeline.run(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in before.collect() if r.text}
    assert {r.doc_id for r in packed} == set(texts)
    by_sequence = Counter()
    for r in packed:
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= 1024


def test_pipeline_catches_what_is_planted(spark):
    """Toxic texts, junk, copies, near copies and repeated passages go; clean documents come out as they were."""
    rng = np.random.default_rng(9)
    common = "the of and to in it is on that for".split()
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    prose = lambda n: " ".join(f"{rng.choice(common)} {rng.choice(words)}" for _ in range(n // 2))
    shared = prose(56)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        text = prose(80).split(" ")
        for at in rng.integers(0, 80, 6):
            if toxic:
                text[at] = rng.choice(["idiot", "worthless", "disgusting"])
        rows.append((i, " ".join(text) + ".", "en"))
        labels.append((i, 1, int(toxic)))
    clean = {500 + i: prose(90) + "." for i in range(20)}
    copy = prose(120) + "."
    rows += [(i, t, "en") for i, t in clean.items()] + [(600, copy, "en"), (601, copy, "en"), (602, copy.replace("the", "a", 1), "en")]
    rows += [(700 + i, f"{prose(60)} {shared} {prose(60)}.", "en") for i in range(3)] + [(800, prose(80).replace(" ", "|#$ "), "en")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = f"{Scratch(spark, 'planted').root}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    at, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, at, folder).collect()
        seen[name], at = {r.doc_id: r.text for r in kept}, spark.createDataFrame(kept, docs.schema)
    toxic, rules, near, suffix = (seen[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert sum(i in toxic for i in range(0, 300, 3)) <= 5 and sum(i in toxic for i in range(300) if i % 3) >= 195
    assert 800 not in rules and set(clean) <= set(rules)
    assert {600, 601, 602} & set(near) == {600}
    assert all(suffix[i] == t for i, t in clean.items())
    assert not any(shared in suffix[700 + i] for i in range(3)) and all(shared in near[700 + i] for i in range(3))
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(suffix)


def test_no_long_passage_is_left(spark):
    """After the stage no 51 words in a row stand in two documents, on a fixture where many did before."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    near = spark.createDataFrame(corpus_pipeline.one_of_each_group(spark, docs, "").collect(), docs.schema)

    def shared(rows):
        found: dict[int, set[int]] = {}
        for k, r in enumerate(rows):
            words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
            for i in range(len(words) - 50):
                part = words[i : i + 51]
                if len(" ".join(part).encode()) >= 200:
                    found.setdefault(hash(" ".join(part)), set()).add(k)
        return sum(len(d) > 1 for d in found.values())

    assert shared(near.collect()) > 500
    assert shared(corpus_pipeline.cut_repeats(spark, near, "").collect()) == 0


def test_pipeline_takes_nulls_and_copies(spark):
    text = "the quick brown fox of the old town and a dog that is lazy " * 1
    long = " ".join(f"{w}{i}" for i in range(30) for w in ("the", "of", "and", "to")) + "."
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (None, long, None, None, None), (2, None, "en", "s", 0), (3, "", "xx", None, 0), (4, text, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() >= 0, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    kept = corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()
    assert sorted((r.doc_id, bool(r.text)) for r in kept if r.doc_id) == [(1, True), (2, False), (4, True)]
