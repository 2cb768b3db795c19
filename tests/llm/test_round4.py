"""Source divergence, centroid clustering and chat formatting against brute force, over awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# 11

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergence_by_hand(rows, least, most):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(UPPER))
        groups.add((lang, source))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    kept = {lang: [t for t in c if c[t] >= least] for lang, c in df.items()}

    def shares(lang, counts):
        total, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + (10**9 * (counts[t] + 5)) // (total + 5 * v) for t in kept[lang]}

    out = []
    for lang, source in groups:
        p = shares(lang, n[lang, source])
        q = shares(lang, sum((n[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in (g for g in groups if g[0] == lang and g[1] != source):
            r = shares(lang, n[other])
            pairs.append((-sum(abs(p[t] - r[t]) for t in p), other[1].encode()))
        terms = sorted((q[t] - p[t], t.encode()) for t in p if n[lang, source][t] > 0 and p[t] > q[t])[:most]
        for part, found in (("pair", sorted(pairs)), ("term", terms)):
            out += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


WILD = [
    (1, None, None, None), (2, "", "en", None), (3, "Aa aa AA aa-b'b ÀÉ ß1ß _x^`y{z|}~", "en", "a"), (3, "Aa aa AA aa-b'b ÀÉ ß1ß _x^`y{z|}~", "en", "a"),
    (None, "aa bb \u00a0\u3000 日本 日本", "en", "b"), (5, "123 456 !!", "en", "only digits"), (6, "bb cc", None, "a"), (7, "solo", "xx", "a"), (8, "aa " * 700_000 + "zz" * 700_000, "en", "c"),
]


def test_divergence(spark, sf):
    from sparkloom.llm.divergence import divergence

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + WILD
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(7) for c in ("term", "n", "df", "item", "value", "rank", "part", "kept", "base", "kind", "total")}).repartition(5)
    for least, most in ((1, 7), (3, 50), (30, 50), (10_000, 5)):
        got = sorted(tuple(r) for r in divergence(docs, least, most).collect())
        assert got == divergence_by_hand([(r[2], r[3], r[1]) for r in rows], least, most)
    assert divergence(docs.where("false")).collect() == []


def test_divergence_in_small_steps(spark, monkeypatch):
    """Sums that are sent early, one source with a third of all rows, many sources."""
    import sparkloom.llm.divergence as D

    monkeypatch.setattr(D, "ENTRIES", 5)
    rows = [(i, f"hot w{i % 13} w{i % 7} {'hot ' * (i % 5)}", "en", "big" if i % 3 else f"s{i % 40}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    assert sorted(tuple(r) for r in D.divergence(docs, 30, 50).collect()) == divergence_by_hand([(r[2], r[3], r[1]) for r in rows], 30, 50)


def test_terms_in_pieces(monkeypatch):
    import sparkloom.llm.divergence as D

    text = "Ab  cd'é " * 50 + "x" * 300 + " end"
    whole = [t.encode() for t in TERM.findall(text.translate(UPPER))]
    for piece in (1, 7, 100, 10_000):
        monkeypatch.setattr(D, "PIECE", piece)
        assert [t for p in D.terms_of(text.encode()) for t in p] == whole
    assert [t for p in D.terms_of(b"") for t in p] == []


def test_divergence_figures_are_exact(spark):
    from sparkloom.llm.divergence import _share, _shares

    n, total, kept = [3, 10**13, 0], [10**14, 3 * 10**13, 7], [9, 10**6, 1]
    want = [1 + 10**9 * (a + 5) // (b + 5 * c) for a, b, c in zip(n, total, kept, strict=True)]
    assert _shares(*(np.array(x) for x in (n, total, kept))).tolist() == want
    df = spark.createDataFrame(list(zip(n, total, kept, strict=True)), "n long, t long, k long")
    assert [r[0] for r in df.select(_share(F.col("n"), F.col("t"), F.col("k"))).collect()] == want


# 12


def clusters_by_hand(rows, k, rounds, dims):
    whole = lambda x: math.floor(Fraction(x) * 1024)
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def nearest(v):
        return min((far(v, c), j) for j, c in enumerate(centres))[::-1]

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[0]].append(v)
        centres = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else old for j, old in enumerate(centres)]
    placed = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, j, d in placed:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = (1 << 63) - 1
    out = [(i, j, min(d, top), min(inertia[j], top), min(sum(inertia.values()), top), sha[j]) for i, j, d in placed]
    return sorted(out, key=repr)


def test_clusters(spark, sf):
    from sparkloom.llm.centroids import clustered, trained

    real = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    v = real[0][1]
    odd = [(-1, None), (-2, []), (-3, v[:63]), (-4, v + [0.0]), (-5, [*v[:63], None]), (-6, [*v[:63], float("nan")]), (-7, [float("inf")] + v[1:]), (None, v), real[5], real[5]]
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(real + odd, schema).withColumns({c: F.lit(7) for c in ("id", "v", "norms", "cluster", "distance", "h")}).repartition(4)
    got = clustered(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == clusters_by_hand(real + odd, 8, 10, 64)
    assert clustered(df.where("false")).collect() == [] and clustered(df.where("vec_id < 0")).collect() == []
    few = [(i, v) for i in range(3)]
    assert sorted((tuple(r) for r in clustered(spark.createDataFrame(few, schema)).collect()), key=repr) == clusters_by_hand(few, 8, 10, 64)
    _, centroids = trained(df, rounds=3)
    assert 0 < centroids.exact <= centroids.possible == 3 * 8 * (len(real) + 3)


def test_clusters_of_far_apart_groups_are_screened(spark):
    """Vectors in groups of different norms: bounds leave little more than one distance a vector."""
    from sparkloom.llm.centroids import trained

    rng = np.random.default_rng(1)
    rows = [(i, ((1 + i % 8) * (1 + 0.01 * rng.standard_normal(64))).tolist()) for i in range(400)]
    _, centroids = trained(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rounds=5)
    assert centroids.exact < 0.6 * centroids.possible


@pytest.mark.parametrize("scale", [1e5, 1e20, 3e38, 1.5e308])
def test_clusters_of_large_components(spark, scale):
    from sparkloom.llm.centroids import clustered

    rng = np.random.default_rng(2)
    rows = [(i, (scale * rng.uniform(-1, 1, 5)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in clustered(df, k=3, rounds=3, dims=5).collect()), key=repr)
    want = clusters_by_hand(rows, 3, 3, 5)
    if scale < 1e10:
        assert got == want
    else:  # inertias are sums of given distances
        assert [(r[0], r[1], r[2], r[5]) for r in got] == [(r[0], r[1], r[2], r[5]) for r in want]


@given(st.integers(-(1 << 200), 1 << 200))
def test_digits(x):
    from sparkloom.llm.centroids import DIGIT, digits

    assert sum(d << (DIGIT * i) for i, d in enumerate(digits(x))) == x and all(abs(d) <= 1 << DIGIT for d in digits(x))


# 13

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<", "[", "\\", "s>", "/s>", "INST]", " ", "\n", "a", "é🦖", ">", "]", "user"]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>[ROLE]", "User"]), st.lists(st.sampled_from(PIECES), max_size=9).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_format_reads_back(turns):
    from sparkloom.llm.chat import Format

    how = Format()
    text, spans = how.template.render([{"role": r, "text": t} for r, t in turns])
    assert list(how.read(text)) == turns
    assert [how.restore(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]
    for _, t in turns:
        assert how.restore(how.escape(t)) == t and not how._control.search(how.escape(t))


def test_template_language():
    from sparkloom.llm.template import Template, TemplateError

    render = lambda source, **env: Template(source, lambda x: f"<{x}>").render(env.get("messages", []))[0]
    ms = [{"role": "a", "text": "x"}, {"role": "b", "text": " y "}]
    cases = {
        "a{# c }} #}b": "ab",
        "{{ 1 + 2 * 3 - 4 // 2 % 3 }}": "5",
        "{{ 'a' ~ 1 ~ true ~ none }}": "a1true",
        "{{ -2 < 1 and not 1 == 2 }}|{{ 'b' in 'abc' }}|{{ 4 not in [1, 2] }}": "true|true|true",
        "{{ 'yes' if 1 > 2 else \"no\" }}": "no",
        " {%- if 1 == 1 -%} t {%- else -%} f {%- endif -%} ": "t",
        "{% if x %}a{% elif x is defined %}b{% else %}c{% endif %}": "c",
        "{% for m in messages %}{{ loop.index }}{{ loop.first }}{{ loop.last }}{{ m['role'] }}{{ m.text | trim | upper }};{% endfor %}": "1truefalseaX;2falsetruebY;",
        "{% for m in messages[1:] %}{{ m.role }}{% endfor %}{{ messages | length }}{{ messages[-1].role }}": "b2b",
        "{% set z = 'q' %}{{ z | escape }}{{ [1, 2] | join('-') }}{{ nope | default('d') }}": "<q>1-2d",
        "{{ '}}' ~ '%}' }}{{ \"\\n\" }}": "}}%}\n",
        "{% if messages %}{{ messages | first is defined }}{% endif %}": "true",
    }
    for source, want in cases.items():
        assert render(source, messages=ms) == want, source
    for bad in ("{% if 1 %}", "{{ 1 + }}", "{{ x.__class__.__mro__ }}", "{{ 'a' * 1000000 }}", "{{ f() }}", "{% endif %}", "{{ 'a' | nope }}", "{{ 1 // 0 }}", "{{ messages[0]['role'].upper }}", "{% for x in 'abc' %}{% endfor %}", "{{ a b }}", "{{ $ }}", "{% while 1 %}"):
        with pytest.raises(TemplateError):
            render(bad, messages=ms) if "x." not in bad else Template(bad)._all({"x": object()}, __import__("sparkloom.llm.template", fromlist=["Output"]).Output())


def test_template_folds_constants():
    from sparkloom.llm.template import Step, Template

    assert Template("a{{ 1 + 1 }}b{% if false %}c{% elif 2 > 1 %}d{% else %}e{% endif %}{{ 'x' | upper }}").tree == (Step("text", "a2bdX"),)
    assert Template("{% if x and true and false %}c{% endif %}{{ true and x }}").tree[-1].parts[0].kind == "name"


def test_formats_that_cannot_be_used():
    from sparkloom.llm.chat import Format
    from sparkloom.llm.template import TemplateError

    loop = "{% for m in messages %}{{ m.role | escape }}<a>{{ m.text | escape }}<b>{% endfor %}"
    good = Format(loop, ("<a>", "<b>"))
    assert list(good.read(good.template.render([{"role": "<a>", "text": "<\\b>"}])[0])) == [("<a>", "<\\b>")]
    for source in ("{{ messages[0].text }}" + loop, loop + loop, loop.replace("<b>", ""), loop.replace("m.role | escape", "m.role"), loop.replace("{{ m.role | escape }}<a>", ""), loop.replace("<b>", "{{ loop.index }}<b>")):
        with pytest.raises(TemplateError):
            Format(source, ("<a>", "<b>")).branches  # noqa: B018
    for controls in (("<a<",), ("<",), ("<a>", "a<b"), ("<\\a>",)):
        with pytest.raises(TemplateError):
            Format(loop, controls)


def chats_by_hand(rows, how):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn, role or "", text or ""))
    out = []
    for conv, turns in own.items():
        turns = [(r, t) for _, _, r, t in sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))]
        lost = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        whole = how.template.render([{"role": r, "text": t} for r, t in turns])[0]
        out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(whole)))
    return sorted(out, key=repr)


COUNTED = "{{ '<s>' }}{% for m in messages %}{{ 'first' if loop.first else '' }}{{ '[INST]' if loop.index % 2 == 1 else '[/INST]' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '[ROLE]' if loop.last else '[/ROLE]' }}{% endfor %}{{ '</s>' }}"


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chats(spark, sf, apart):
    from sparkloom.llm.chat import Format, digests, formatted

    schema = "conv_id long, turn long, role string, text string"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, None, None), (None, None, "assistant", "late? \\<s>"), (-2, 0, "assistant", ""), (-2, 0, "assistant", ""), (-3, 1, "user", "b"), (-3, 1, "user", "a"), (-4, 0, "assistant", "x[/INST" * 90_000)]
    rows += [(777, i // 2, ("user", "assistant")[i % 2], f"turn {i} <s> " + "y" * (i % 50)) for i in range(6_000)]  # most of all rows
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(7) for c in ("segment", "whole", "loss", "n_turns")}).repartition(7)
    how = Format()
    for size in (1 << 20, 100):
        laid = formatted(df, how, segment=size)
        assert sorted((tuple(r) for r in digests(laid, how).collect()), key=repr) == chats_by_hand(rows, how)
    parts = laid.where("conv_id = 777").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1  # the large conversation lies in several tasks
    assert formatted(df.where("false")).collect() == [] and digests(formatted(df.where("false"))).collect() == []
    # marks that depend on the place come out as in one piece, though they can't be read back
    how = Format(COUNTED)
    with pytest.raises(ValueError, match="read back"):
        digests(formatted(df, how), how).collect()
    whole = how.template.render([{"role": r[2], "text": r[3]} for r in sorted(x for x in rows if x[0] == 777)])[0]
    made = formatted(df, how, segment=5_000).where("conv_id = 777").orderBy("segment").collect()
    assert len(made) > 3 and "".join(r["text"] for r in made) == whole


# 7


def test_word_memory_is_bounded_by_characters(monkeypatch):
    """Unspaced script: sentences are words; the memory turns over by their characters."""
    from sparkloom.llm import packing
    from sparkloom.llm.queries import word_tokenizer

    monkeypatch.setattr(packing, "KEPT_CHARS", 20_000)
    path = word_tokenizer()
    tokenizer, memory = packing._tokenizer(path)
    texts = ["".join(chr(0x4E00 + (i * j) % 5000) for j in range(400)) + f" word{i}" for i in range(300)]
    for start in range(0, 300, 20):
        some = texts[start : start + 20]
        want = [packing._bytes(tokenizer.encode(t, add_special_tokens=False).ids) + packing.END for t in some]
        assert list(packing.encode_texts(some, path)) == want
        assert all(sum(map(len, m)) < 60_000 for m in memory[1:] if start > 100)


def test_words_encoded_between_marks(monkeypatch):
    """Words that are learned together get the ids that they have alone, also marks themselves, combining signs first and long ones; one text is encoded for many words."""
    from sparkloom.llm import packing
    from sparkloom.llm.queries import word_tokenizer

    path = word_tokenizer()
    tokenizer, memory = packing._tokenizer(path)
    memory[:] = [{}, {}]
    rng = random.Random(9)
    signs = ["a", "E", "ß", "Σ", "\u0301", "\u0345", "İ", "7", "'s", "*", ".", ",", "漢", "😀", "\u200d", "\x00", "\x02", "<|endoftext|>", "\ufeff"]
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(3_000)] + ["x" * 5_000, "é.", "İ.", "aİ,", "\u0958."]
    called = []

    class Counted:
        encode = staticmethod(tokenizer.encode)

        @staticmethod
        def encode_batch_fast(texts, **options):
            called.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setitem(packing._loaded, path, Counted)
    for some in (words, [*words[:50], "\x01", "a\x01b", "\x01\x01"]):  # marks among the words: one by one
        want = [packing._bytes(tokenizer.encode(w, add_special_tokens=False).ids) for w in some]
        assert packing._encoded(some, Counted) == want
    called.clear()
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)] + ["", "a\x01b \x01 c"]
    want = [packing._bytes(tokenizer.encode(t, add_special_tokens=False).ids) + packing.END for t in texts]
    assert list(packing.encode_texts(texts[:-1], path)) == want[:-1] and len(called) < 100  # thousands before
    assert list(packing.encode_texts(texts, path)) == want
    memory[:] = [{}, memory[0]]  # older memory
    assert list(packing.encode_texts(texts, path)) == want
    memory[:] = [{}, {}]


class Plan:
    """Takes the function that a DataFrame would run on its batches."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def test_packing_worker_memory_is_bounded_by_a_step(spark):
    """A batch's texts aren't strings all at once: 120 MB of them here, if so."""
    import tracemalloc

    import pyarrow as pa

    from sparkloom.llm import packing
    from sparkloom.llm.queries import word_tokenizer

    path = word_tokenizer()
    packing._tokenizer(path)
    text = " ".join(f"{'wordy' * 12}{chr(97 + i % 26)}" for i in range(160)) + " \U0001f600"
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000), pa.int64()), pa.array([text, None, ""] + [text] * 2_997)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        rows = pa.Table.from_batches(packing.pieces(Plan(spark.range(1).toDF("doc_id").schema), path, 4096).function(iter([batch]))).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6
    ids = [*packing._loaded[path].encode(text, add_special_tokens=False).ids, 1]
    first = [r["length"] for r in rows if r["doc_id"] == 0]
    assert sum(first) == len(ids) and {r["doc_id"] for r in rows} == set(range(3_000)) and len(rows) == 2_998 * len(first) + 2


def test_packing_steps_hold_all_rows(monkeypatch):
    import pyarrow as pa

    from sparkloom.llm import packing

    monkeypatch.setattr(packing, "STEP_BYTES", 10)
    monkeypatch.setattr(packing, "STEP_TEXTS", 3)
    for texts in ([], [None], ["x" * 50], ["", None, "", "", "abc"], ["x" * 4] * 5 + ["y" * 30, "z", None, "é" * 5, "z"]):
        whole = pa.array(["cut", *texts], pa.string()).slice(1)
        found = list(packing.steps(whole))
        assert [i for at, n in found for i in range(at, at + n)] == list(range(len(texts)))
        for at, n in found:
            assert 1 <= n <= 3 and (n == 1 or sum(len((t or "").encode()) for t in texts[at : at + n]) <= 10)


def test_packing_takes_small_batches(spark):
    """Neither side holds more than a thousand texts for one transfer, and the session's own setting stays."""
    from sparkloom.llm.packing import pack
    from sparkloom.llm.queries import word_tokenizer

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def told(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array(["x"])], ["doc_id", "text"])

    docs = spark.range(0, 5_000, 1, 1).mapInArrow(told, "doc_id long, text string")
    sizes = [r["doc_id"] for r in pack(docs, word_tokenizer()).collect()]
    assert sum(sizes) == 5_000 and max(sizes) <= 1_024 and spark.conf.get(key) == before


def test_word_memory_keeps_parts_alone():
    """A word with capitals or signs at its end takes no place beside its part, and special tokens are such in small letters alone."""
    from sparkloom.llm import packing
    from sparkloom.llm.queries import word_tokenizer

    path = word_tokenizer()
    tokenizer, memory = packing._tokenizer(path)
    memory[:] = [{}, {}]
    signs = ["", ".", ",", "!!", "?", ";", ":", "###", ".***", ".&&&", ",%%%", "$$$", "...", "|>", "'", "'s", ".'s", "'s.", "<", ")."]
    forms = [form + sign for word in ("retion", "été", "İ", "o'", "don't", "7", "a1", "ß", "漢", "e\u0301") for form in (word, word.title(), word.upper()) for sign in signs]
    special = ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|EndOfText|>.", "A<|startoftext|>###", "<|STARTOFTEXT|>!", "X<|endoftext|>Y."]
    texts = [*forms, *special, " ".join(forms), " ".join(special), " ".join(forms + special), "PLAIN Text. Plain text!"]
    want = [packing._bytes(tokenizer.encode(t, add_special_tokens=False).ids) + packing.END for t in texts]
    for _ in range(2):
        assert list(packing.encode_texts(texts, path)) == want
        memory[:] = [{}, memory[0]]
    memory[:] = [{}, {}]
    list(packing.encode_texts([f"word{a} Word{a} WORD{a}. word{a}### word{a}!!" for a in "abcdefghij"], path))
    list(packing.encode_texts([f"été{a}z été{a}z. Été été{a}z###" for a in "abcdefghij"], path))
    assert len(memory[0]) < 30  # 82 before
    memory[:] = [{}, {}]
