"""Each operator against a plain version, on texts with nulls, empty and long ones, ties and repeated rows."""

import collections
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_plain import LOWER, linked, without_copies, words

from shapeframe.llm.common import Sieve
from shapeframe.llm import arrays, chat, components, decontam, htmltext, jaccard, linededup, mixing, pii, quality, tokens, urlfilter

#: Names that operators use inside, as columns of the input.
CLASHES = ("id", "th", "ln", "run", "size", "target", "taken", "shard", "token", "cls", "label", "host", "key", "listed", "n", "score", "_h", "_end", "e")


def corpus(seed=1, n=60):
    """(doc_id, text, source): copies, near copies, shared passages, odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = "\n".join(say(12) for _ in range(6))
    texts = [None, "", " \n\t ", "one", "Two words", "a b c d", "A B C D", "x " * 3000, "\n".join(["same line"] * 40), "\n\n\n"]
    for _ in range(n):
        kind = r.random()
        if kind < 0.3 and len(texts) > 12:
            texts.append(r.choice(texts[10:]))
        elif kind < 0.6 and len(texts) > 12:
            w = (r.choice(texts[10:]) or "x").split(" ")
            for _ in range(max(1, len(w) // r.choice((10, 30, 60)))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            lines = [say(r.randint(1, 25)) for _ in range(r.randint(1, 12))]
            if r.random() < 0.3:
                lines.insert(r.randrange(len(lines) + 1), passage)
            texts.append("\n".join(lines))
    return [(i, t, r.choice(("s0", "s0", "s1", "é", None))) for i, t in enumerate(texts)] + [(3, "one", "s0"), (None, "null id", "s1"), (None, texts[12], None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


# 1 ------------------------------------------------------------------------------------------------------------------


def test_targets_fill_by_weight_up_to_the_cap(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 500}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    weight, left, want = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in want]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("seats", [0, 1, 2, 7, 100, 1001])
def test_apportionment_is_by_highest_quotients(spark, seats):
    r = random.Random(seats)
    w = [(i, r.choice((0, 1, 5, 5, 17, 300)), seats) for i in range(9)]
    got = {x.i: x.won for x in mixing.apportion(spark.createDataFrame(w, "i long, w long, seats long"), [], "w", "seats", [F.col("i")], "won").collect()}
    won = dict.fromkeys(range(9), 0)
    for _ in range(seats):
        best = max(w, key=lambda p: (p[1] / (2 * won[p[0]] + 1), -p[0]))
        won[best[0]] += bool(best[1])
    assert got == won


def test_mix(docs, nothing):
    run = lambda: sorted(map(tuple, mixing.mix_sources(docs, shard_words=200, block=4).collect()), key=str)
    rows = run()
    assert rows == run() and len(rows) == docs.count()
    by = collections.defaultdict(list)
    for doc_id, source, size, source_size, target, taken, ranges, _ in rows:
        assert 0 <= taken <= 2 * size and all(0 <= a < b <= size for a, b in ranges) and sum(b - a for a, b in ranges) == taken
        by[source].append((size, taken, source_size, target))
    for group in by.values():
        assert sum(x[0] for x in group) == group[0][2]
        assert abs(sum(x[1] for x in group) - group[0][3]) <= 1
    assert sorted(str((d, len(words(t)))) for d, t, _ in corpus()) == sorted(str((r[0], r[2])) for r in rows)
    assert mixing.mix_sources(nothing).count() == 0


def test_mix_of_tiny_sources(spark):
    import corpus_pipeline

    rows = [(i, "en", "large", 1, "word " * 300) for i in range(20)] + [(100, "en", "m", 1, "a b c"), (101, "en", "n", 1, "a b c d e"), (102, "en", "o", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    got = corpus_pipeline.mix(spark, docs, "").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r.source for r in got} == {"large", "m", "n", "o"} and all(abs(r.taken - r.target) <= 1 for r in got)


# 2 ------------------------------------------------------------------------------------------------------------------

URLS = [None, "", "nothing", "http://", "http://Org/a", "https://x.EXAMPLE.org/es/1?q", "http://example.org/en/12#f", "http://example.org", "http://a.com/fr/1", "http://a.com/de/", "http://a.com/en", "http://acom/de/", "x://b.com?de/", "http://b.net/ü/é?x", "ftp://a.com/de/"]


@pytest.mark.parametrize("most", [2048, 0])
def test_urls(spark, most):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, key string")
    rows = {r.page_id: r for r in urlfilter.judge_urls(pages, urlfilter.RULES, max_segments=most).collect()}
    want, listed = {}, set()
    for i, u in enumerate(URLS * 2):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        want[i] = (host, path, best)
        if best and best[2] == "block":
            listed.add(host)
    for i, (host, path, best) in want.items():
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, best[0] + best[1] if best else None)
        assert r.listed == (host in listed) and r.verdict == (best[2] if best else "block" if host in listed else "allow")
    assert urlfilter.judge_urls(pages.where("false"), urlfilter.RULES, max_segments=most).count() == 0


@pytest.mark.parametrize("most", [2048, 0])
def test_cascade_is_exact_though_its_levels_are_not(spark, most):
    keys = spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    c = urlfilter.Cascade(keys, bits_per_key=(1, 1), hashes=(1, 1), max_segments=most)
    assert len(c.levels) > 2 and c.local == (most > 0)
    assert c.member(keys, "key", "got").where("got <> listed").count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


def test_columns_of_any_name(spark):
    rows = [(i, f"{'same words in all of these texts ' * 3}{i // 4}", "s", i, i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _drop_hash int, _drop_id int")
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns and all(r._drop_hash == r.doc_id for r in kept.collect())
    mixed = mixing.mix_sources(docs.withColumnsRenamed({"_drop_hash": "size", "_drop_id": "ranges"}), carry=("size", "ranges", "text"))
    assert len(set(mixed.columns)) == len(mixed.columns) and mixed.where("size_ = doc_id").count() == 12


@pytest.mark.parametrize("keys", [0, 10, 5000])
def test_sieve_misses_no_key(spark, keys):
    found = Sieve(spark.range(keys), "id", segments=1)
    marked = spark.range(20_000).withColumn("may", found.may(F.col("id")))
    assert marked.where(F.col("id") < keys).where("NOT may").count() == 0
    assert marked.where(F.col("id") >= keys).where("may").count() < (5000 if keys else 1)


@pytest.mark.parametrize("chunk", [384, 2])
def test_near_copies(spark, docs, nothing, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(components, "AT_ONCE", 1_000_000 if chunk > 2 else 0)
    rows = corpus()
    n, component = linked(rows)
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.link_documents(docs).collect())
    assert got == sorted(str((rows[i][0], n[i], component[i])) for i in range(len(rows)))
    if chunk > 2:
        kept = jaccard.drop_near_copies(docs)
        assert kept.columns == docs.columns
        kept = [(r.doc_id, r.text) for r in kept.collect()]
        groups = {c for c, k in zip(component, n, strict=True) if k and c is not None}
        assert len([1 for d, t in kept if words(t) and d is not None]) == len(groups)
        assert jaccard.link_documents(nothing).count() == 0 and jaccard.drop_near_copies(nothing).count() == 0


def test_large_groups_and_long_chains(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):  # a star: each near the base
        w = list(base)
        for _ in range(3):
            w[r.randrange(200)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w), None))
    w = [f"c{r.randrange(5000)}" for _ in range(120)]
    for i in range(40):  # a chain: each near the one before only
        w = list(w)
        w[(3 * i) % 118 : (3 * i) % 118 + 2] = [f"y{i}a", f"y{i}b"]
        rows.append((1000 + i, " ".join(w), None))
    n, component = linked(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {rows[i][0]: (n[i], component[i]) for i in range(len(rows))}


@pytest.mark.parametrize("chunk", [384, 20])
def test_each_pair_is_handed_out_in_one_tree(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    run, made = jaccard.over_batches, []

    def counted(df, function, schema):
        out = run(df, function, schema)
        if "token" in df.columns and schema == "a long, b long":
            out = out.localCheckpoint()
            made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "over_batches", counted)
    r = random.Random(5)
    rows = []
    for base, edits, many in ((0, 3, 90), (1, 16, 60)):  # near copies, and texts that mostly are not near enough
        words = [f"v{base}x{r.randrange(5000)}" for _ in range(200)]
        for _ in range(many):
            w = list(words)
            for _ in range(r.randrange(1, edits + 1)):
                w[r.randrange(200)] = f"z{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), None))
    n, component = linked(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {rows[i][0]: (n[i], component[i]) for i in range(len(rows))}
    assert all(n <= 1.1 * distinct + 5 for n, distinct in made), made


def test_few_rows_take_few_jobs_and_tasks_whatever_the_partitions(spark):
    """Before, a filter's parts came by a job for each partition, and each step read as many parts as the last shuffle had."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(base[: 59 - i % 6] + [f"x{i}"]), "a") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, context = {k: spark.conf.get(k) for k in settings}, spark.sparkContext
    tracker = context.statusTracker()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few rows", "few rows")
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.link_documents(docs).collect()}
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few rows")]
        stages = [tracker.getStageInfo(k) for j in jobs if j for k in j.stageIds]
        tasks = sum(x.numCompletedTasks for x in stages if x)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    n, component = linked(rows)
    assert got == {rows[i][0]: (n[i], component[i]) for i in range(len(rows))}
    assert len(jobs) < 130 and tasks < 1200, (len(jobs), tasks)


# 4 ------------------------------------------------------------------------------------------------------------------

CALC = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "number"}}, "r": {"type": "object"}}, "additionalProperties": False}}


def call(i, arguments, name="add"):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': arguments})}</tool_call>"


def result(i, content="ok"):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hé \"x\"\n"),
        (1, 1, "assistant", "first " + call("a", {"a": 1}) + call("b", {"a": 2, "r": {"$ref": "a"}})),
        (1, 0, "tool", result("b")),
        (1, 5, "tool", result("a")),
        (1, 6, "assistant", call("c", {"a": -1, "b": [1, "x"], "z": 1}) + call("d", {"a": 1}, "none") + "<tool_call>broken</tool_call>"),
        (1, 7, "assistant", call("e", {"a": 1, "r": {"$ref": "f"}}) + call("f", {"a": 1, "r": {"$ref": "e"}})),
        (1, 8, "tool", result("nobody")),
        (2, 0, None, None),
        (2, 0, None, None),
        (None, None, "user", ""),
        (3, 0, "assistant", call("a", {"a": 1}) + call("a", {"a": 2})),
        (3, 1, "tool", result("a", 1)),
        (3, 2, "tool", result("a", 2)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("kind", "call_id", "place", "json")})
    got = chat.format_chat(df, CALC).collect()
    at = {(r.conv_id, r.kind, r.call_id, r.turn, r.part): r for r in got}
    a, b = at[1, "call", "a", 1, 1], at[1, "call", "b", 1, 2]
    assert a.linked and a.valid and (a.place, a.depth) == (1, 0)
    assert b.linked and (b.place, b.depth) == (5, 2)
    assert (at[1, "result", "b", 0, 0].place, at[1, "result", "b", 0, 0].depth) == (5, 3)
    assert (at[1, "result", "a", 5, 0].place, at[1, "result", "a", 5, 0].depth) == (5, 1)
    c = at[1, "call", "c", 6, 0]
    assert not c.valid and not c.linked and "$.a: bounds" in c.errors and "$.b[1]: not number" in c.errors and "$.z: unknown" in c.errors
    assert at[1, "call", "d", 6, 1].errors == "$: no schema"
    assert at[1, "call", "e", 7, 0].place is None and at[1, "call", "f", 7, 1].depth is None
    assert not at[1, "result", "nobody", 8, 0].linked
    assert at[1, "text", None, 0, 0].json == '{"content":"hé \\"x\\"\\n","role":"user","type":"text"}'
    assert a.json == '{"arguments":{"a":1},"id":"a","name":"add","role":"assistant","type":"call"}'
    assert sum(r.conv_id == 2 for r in got) == 2 and sum(r.conv_id is None for r in got) == 1
    assert all(r.linked for r in got if r.conv_id == 3)
    assert chat.format_chat(df.where("false"), CALC).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def test_hostile_markup(spark):
    deep = "[" * 200_000 + "]" * 200_000
    bodies = [r'{"id": "s\ud800", "name": "add", "arguments": {"a": "\ud800", "\udfff": 1}}', '{"id": 1, "name": "add", "arguments": %s}' % deep, '{"id": 2, "name": "add", "arguments": {"a": %s}}' % ("9" * 400), '{"id": 3, "name": "add", "arguments": {"a": NaN}}', '{"id": 4, "name": "add", "arguments": {"a": -Infinity}}', '{"id": 5, "name": "add", "arguments": {"a": 1e999}}', '{"id": 6, "name": "add", "arguments": {"a": %s}}' % ("9" * 5000), '{"id": 7, "name": "add", "arguments": %s1%s}' % ("[" * 80, "]" * 80)]
    rows = [(i, 0, "assistant", f"<tool_call>{b}</tool_call>") for i, b in enumerate(bodies)]
    got = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"add": {"type": "object", "properties": {"a": {"type": "integer"}}}}).collect()}
    assert [got[i].kind for i in range(8)] == ["call", "text", "call", "text", "text", "text", "text", "text"]
    assert got[0].call_id == "s\\ud800" and not got[0].valid and json.loads(got[0].json)["arguments"] == {"a": "\ud800", "\udfff": 1}
    assert got[2].valid and json.loads(got[2].json)["arguments"]["a"] == int("9" * 400)
    for r in got.values():
        json.loads(r.json, parse_constant=lambda name: pytest.fail(name))


def test_leaks(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    say = lambda k: [r.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(say(r.randint(10, 40)))) for i in range(40)] + [(40, None), (41, ""), (42, "three short words"), (43, "w1 w2 w3 w4 w5 w6 w7")]
    items += [(44, items[0][1])]
    texts, want = [], set()
    for d in range(150):
        w = say(r.randint(0, 400))
        for i in r.sample(range(40), r.choice((0, 0, 1, 2))):
            at = r.randrange(len(w) + 1)
            w[at:at] = items[i][1].upper().split()
        texts.append((d, " ".join(w)))
    norm = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for d, t in texts:
        w = norm(t)
        for i, q in items:
            p = norm(q)
            if any(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1)) and p:
                want.add((d, i))
    docs = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "score", "n")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1_000_000, 60):
        got = {(x.doc_id, x.item_id): x for x in decontam.find_leaks(docs, bench, slice_words=size).collect()}
        assert want <= set(got)
        for (d, i), x in got.items():  # whatever else is found does overlap enough
            p, w = norm(items[i][1]), norm(dict(texts)[d])
            for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :]):
                n = min(5, len(half))
                assert len(grams(half, n) & grams(w, n)) >= 0.5 * len(grams(half, n))
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {d for d, _ in texts} - {d for d, _ in got} | {900, 901}
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0
    assert decontam.find_leaks(docs, bench.where("false")).count() == 0


def test_leaks_of_items_without_an_id(spark):
    items = [(None, "one two three four five six seven eight nine ten"), (None, "red orange yellow green blue indigo violet black white grey"), (7, "a b c d e f g h i j"), (None, None)]
    texts = [(1, f"start {items[0][1]} and {items[1][1]} end"), (2, f"only {items[2][1]} here"), (3, "nothing of the sort")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1_000_000, 10):
        assert sorted((x.doc_id, x.item_id or 0) for x in decontam.find_leaks(docs, bench, slice_words=size).collect()) == [(1, 0), (1, 0), (2, 7)]
        assert [x.doc_id for x in decontam.drop_leaks(docs, bench, slice_words=size).collect()] == [3]


def test_pruning_loses_nothing():
    """The search's answer is that of scoring every passage against every item."""
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 12)))) for i in range(50)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120))) for _ in range(60)]
    coded = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])
    pruned = decontam.Index(items, 0.5, 0.2, 0.0).search(data, at)
    whole = decontam.Index(items, 0.5, -1.0, 0.0)
    whole.needs[:] = -np.inf
    whole.item_needs = np.full(len(whole.ids), -np.inf)
    assert len(pruned) > 50 and pruned == whole.search(data, at)


# 6 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(spark, docs, nothing, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    r = random.Random(6)
    pieces = list("abst're  \n\t'é漢字🎉12³½.,!?- \u00a0\u2028\r_") + ["'s", "'ll", "'ve", "<|endoftext|>", "  ", "\n\n", "don't", "'S", "\x00", "l'l"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["a" * 3000, "= " * 500, "日本" * 400, "\n" * 300, "<|endoftext|>" * 3, "é" * 70]
    with open(vocabulary, encoding="utf-8") as f:
        counter = tokens.Counter(json.load(f))
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: r for r in tokens.count_tokens(docs, vocabulary).collect() if r.doc_id is not None}
    for d, t, _ in corpus():
        if d is not None:
            assert (got[d].n_bytes, got[d].n_tokens) == (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
            assert got[d].over_limit == (got[d].n_tokens > 512)
    assert tokens.count_tokens(nothing, vocabulary).count() == 0


def test_token_transducer_is_the_merges():
    """Vocabularies of random merges, against merging from scratch; long pre-tokens, and a machine that starts anew."""
    r = random.Random(66)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = [chr(b) for b in printable] + [chr(0x100 + i) for i in range(256 - len(printable))]
    for _ in range(40):
        ids, merges, known = {c: i for i, c in enumerate(alphabet)}, [], list("abc")
        for _ in range(r.randint(1, 40)):
            x, y = r.choice(known), r.choice(known)
            if x + y not in ids and len(x + y) < 12:
                ids[x + y] = len(ids)
                merges.append(f"{x} {y}")
                known.append(x + y)
        counter = tokens.Counter({"model": {"vocab": ids, "merges": merges}, "added_tokens": []})
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(100)] + [x * 700 for x in ("a", "ab", "abc", "cab")]
        words += ["".join(r.choice("abc") for _ in range(3000))]
        assert counter.count(words).tolist() == [len(counter.merges.encode(w.encode())) for w in words]


def test_token_transducer_starts_anew(vocabulary, monkeypatch):
    with open(vocabulary, encoding="utf-8") as f:
        vocabulary = json.load(f)
    texts = [t or "" for _, t, _ in corpus(n=20)] + ["x" * 5000]
    want = tokens.Counter(vocabulary).count(texts).tolist()
    monkeypatch.setattr(tokens, "MAX_MOVES", 50)
    monkeypatch.setattr(tokens, "SLICE", 100)
    assert tokens.Counter(vocabulary).count(texts).tolist() == want


# 7 ------------------------------------------------------------------------------------------------------------------


def test_held_out_pages():
    field, wrong, total = htmltext.trained(), 0, 0
    for page, labels in htmltext.labelled_pages(150, 500_000):
        wrong += sum(a != b for a, b in zip(labels, field.decode(page), strict=True))
        total += len(labels)
    assert wrong / total < 0.02


def test_viterbi_is_the_best_path():
    import itertools

    field = htmltext.trained()
    for page, _ in htmltext.labelled_pages(40, 900_000):
        page = page[:7]
        score = lambda ys: sum(field.emission(b, p)[y] for b, p, y in zip(page, htmltext.place_features(page), ys, strict=True)) + sum(field.moves[a, b] for a, b in zip(ys, ys[1:], strict=False)) + field.ends[0, ys[0]] + field.ends[1, ys[-1]]  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(page)), key=score)
        assert score(tuple(field.decode(page))) == pytest.approx(score(best))


def test_pages(spark):
    article = "<p>Al&eacute;pha &amp; <b>be\n ta</b>, a sentence that is long enough to read.<br>More of it here.<p>Second paragraph &#x41;, also long enough to be one of them.</p>"
    html = f"<html><head><title>T</title><script>if (a < b) {{ '</p>' }}</script><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a>About</a></li></ul></nav><!-- <p>no</p> --><article><h1>Title of it</h1>{article}</article><div class='ad'>Buy this now.</div><footer>&copy; x</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", html, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "<div", 1), (5, "u", "<nav><a href='/'>x</a></nav><!-- open", 1), (1, "u", html, 1)], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in htmltext.extract(pages).collect()]
    text = "Title of it\n\nAlépha & be ta, a sentence that is long enough to read. More of it here.\n\nSecond paragraph A, also long enough to be one of them."
    assert got[0] == got[5] == (1, "u", text, len(text)) and got[1] == (2, None, "", 0) and got[2][2] == "" and got[4][2] == ""
    assert htmltext.extract(pages.where("false")).count() == 0


def test_pages_are_read_to_their_end():
    texts = lambda page: [b[1] for b in htmltext.blocks(page)]
    for tag in ("<svg/>", "<svg width='1' />", "<object data='x'>", "<canvas>", "<noscript>", "<select>", "<template>", "<!-->", "<!--->", "<!-- > --!>", "<title-bar>", "<object-view>", "<script-x>", "<svg><title/></svg>", "<svg><svg/><svg>no</svg>no</svg>", "<OBJECT><object>no</object>no</OBJECT>", "<canvas><p>no</p>no</canvas >", "<select><option>no<option>no</select>", "<script>no</script x>"):
        assert texts(f"<p>One {tag} two.</p><p>Three.</p>") == ["One two.", "Three."], tag
    assert texts("<div><canvas>a</div><p>Three.</p><canvas>no</canvas>") == ["a", "Three."]
    assert texts("<p>One <svg><script href='x'/><g>no</g></svg>two.") == ["One two."]
    for tag in ("script", "style", "title", "textarea", "iframe"):
        assert texts(f"<p>One <{tag}> two.</p><p>Three.</p>") == ["One"]


def test_hostile_pages_are_read_in_linear_time():
    import time

    for page in ("<a " * 300_000, '<a "' * 250_000, "<p>x</p>" + '<a "' * 250_001 + "y>", "<!--" * 250_000, "<!x" * 300_000, "<script>" + "</script " * 100_000, '<p class="' * 100_000, "<svg>" * 100_000):
        start = time.process_time()
        htmltext.blocks(page)
        assert time.process_time() - start < 5
    assert [b[1] for b in htmltext.blocks('<p>a</p><a href="x>one</a> two <b>q</b> three</p><p>four')] == ["a", "one two q three", "four"]
    assert [b[1] for b in htmltext.blocks("<div>" * 1000 + "in" + "</div>" * 1000 + "<p>out</p>")] == ["in", "out"]


def test_pages_of_other_designs():
    """Pages written by hand, not by the generator: (label, text) in page order."""
    say = lambda k: " ".join(["Rivers carry sand from the hills down to the sea and leave it where the current slows."] * k)
    pages = [
        f"<html><body><div id='top'><a href='/'>Main page</a> <a href='/r'>Random</a></div><div><h1>River</h1><p>{say(2)}</p><div><h2>Contents</h2><ul><li><a href='#1'>1 Source</a></li><li><a href='#2'>2 Course</a></li><li><a href='#3'>3 Mouth</a></li></ul></div><h2>Source</h2><p>{say(3)}</p><h2>Course</h2><p>{say(4)}</p></div></body></html>",
        f"<html><body><table><tr><td><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></td><td><h1>Sand</h1><p>{say(3)}</p><p>{say(2)}</p></td></tr></table><center>Copyright 2003 The Sand Club</center></body></html>",
        f"<html><body><div><div><a href='/1'>Start</a></div><div><a href='/2'>Blog</a></div></div><div><div>The slow river</div><div>{say(3)}</div><div>{say(2)}</div><div>{say(4)}</div></div></body></html>",
    ]
    wanted = [["River", say(2), "Source", say(3), "Course", say(4)], ["Sand", say(3), say(2)], ["The slow river", say(3), say(2), say(4)]]
    for page, texts in zip(pages, wanted, strict=True):
        assert htmltext.main_text(htmltext.trained(), page) == "\n\n".join(texts)


# 8 ------------------------------------------------------------------------------------------------------------------


def test_quality_counts(spark, docs, nothing):
    labels = spark.createDataFrame([(12, 1, 0), (13, 1, 0), (14, 0, 0), (None, 1, 0), (99999, 1, 1), (15, None, 0)], "doc_id long, quality int, toxic int")
    got = collections.Counter()
    for r in quality.judge(docs, labels).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] += 1
        assert r.kept == (not r.base_failed and r.score >= -0.3)
    want = collections.Counter()
    for d, t, _ in corpus():
        w, seen, dup, again = words(t), set(), 0, set()
        for line in (t or "").split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
            if grams[g] > 1:
                again |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again), failed] += 1
    assert got == want
    assert quality.judge(nothing, labels).count() == 0
    assert {r.score for r in quality.judge(docs, labels.where("false")).collect()} == {0.0}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality.judge(docs, labels).where("kept").collect())


def test_quality_scores_tell_junk(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    say = lambda end: " ".join(r.choice(vocabulary) + end for _ in range(80))
    rows = [(i, say("### |" if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(100)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert all(got[i].kept == (i % 5 != 0) for i in range(300))
    n, bits = 3, 15
    texts = [t.encode() for _, t in rows]
    bucket = lambda b: quality.ngram_buckets(np.frombuffer(b, np.uint8), np.array([0, len(b)]), n, bits)[0]
    raw = sum(np.bincount(bucket(b), minlength=1 << bits) for b in texts)
    target = sum(np.bincount(bucket(b), minlength=1 << bits) for i, b in enumerate(texts[:100]) if i % 5)
    ratio = quality.log_ratios(raw.astype(float), target.astype(float))
    assert got[7].score == pytest.approx(ratio[bucket(texts[7])].mean())


# 9 ------------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def good(kind, s):
        digits = re.sub(r"[^0-9]", "", s)
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good(k, m[0]))


def test_base_spans():
    r = random.Random(3)
    letters = list("0123456789" * 3 + "..@@++-- ()ab:/%é\n")
    for _ in range(20_000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 45)))
        assert [s for s in pii.spans(t) if s[1] < pii.BASE] == base_spans(t)


def test_pii(spark, nothing):
    import hashlib

    text = "é a.b@c.de 1.2.3.4 999.1.1.1 4111 1111 1111 1111 +1 (555) 555-1234 token = \"abcdef0123456789\" IBAN: DE89 3704 0044 0532 0130 00, account 123456789 https://me:secret@host.org/x"
    rows = [(1, text), (2, None), (3, ""), (4, "clean words only, the token of love; an account of it"), (1, text)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    one = got[0]
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text))
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (one.n_email, one.n_ip, one.n_card, one.n_phone) == tuple(sum(s[1] == k for s in base_spans(text)) for k in range(4))
    found = {k: text[int(a) : int(b)] for k, a, b in (s.split(":") for s in one.spans.split(",") if s.split(":")[0] in pii.KINDS[4:])}
    assert found["secret"] == "abcdef0123456789" and found["login"] == "me:secret" and one.n_account == 2
    assert all(s in one.spans.split(",") for s in base.split(","))
    assert got[1].spans == got[2].spans == got[3].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[4] == one
    assert pii.find_pii(nothing).count() == 0


def test_cues():
    import time

    for text in ("ApiKey: abcdef0123456789", "Api Key = abcdef0123456789", "api-key: abcdef0123456789", "Authorization: Bearer abcdef0123456789", 'TOKEN="abcdef0123456789"', '{"password": "abcdef0123456789"}'):
        assert [text[a:z] for a, k, z in pii.spans(text) if pii.KINDS[k] == "secret"] == ["abcdef0123456789"], text
    for text in (("iban" + " " * 8000) * 100, ("account no" + " .:" * 3000) * 100, ("token" + " " * 8000) * 100, "a" * 1_000_000 + "@", "1" * 1_000_000, "token=" + "a" * 1_000_000, "x://" + "a:" * 500_000):
        start = time.process_time()
        pii.spans(text)
        assert time.process_time() - start < 5


# 10 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_runs(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdef") for _ in range(k)) for k in (0, 0, 1, 2, 3, 5, 8)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(25)] + [(90, None), (91, ""), (92, "\n\n")]
    rows += [(100, "\n".join(["a b c d e f g h i j"] * 30))]
    want = without_copies(rows, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)
    got = {x.doc_id: (x.text, x._n_removed) for x in linededup.dedup_documents(df, 9).collect()}
    assert got == {rows[i][0]: want[i] for i in range(len(rows))}


@pytest.mark.parametrize("rows, hot", [(0, 1), (0, 1_000_000), (400_000, 1_000_000)])
def test_line_runs_hot_and_shuffled(spark, monkeypatch, rows, hot):
    """No key or every key counts as hot, and cuts are broadcast or met behind a Bloom filter: the same result."""
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "small", lambda df: df if not rows else F.broadcast(df))
    r = random.Random(8)
    passage = "\n".join(" ".join(r.choice("abcdef") for _ in range(4)) for _ in range(3))
    texts = [passage if r.random() < 0.6 else "\n".join(" ".join(r.choice("abcdef") for _ in range(5)) for _ in range(4)) for _ in range(60)]
    found = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "")]
    want = without_copies(found, 9)
    df = spark.createDataFrame(found, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_cut_hash", "_cut_id", "n", "_salt", "_n_lines")})
    out = linededup.dedup_documents(df, 9)
    assert out.columns == [*df.columns[:-1], "_n_lines", "_n_removed"]
    assert {x.doc_id: (x.text, x._n_removed) for x in out.collect()} == {found[i][0]: want[i] for i in range(len(found))}


def test_line_dedup_edges(spark, docs, nothing):
    assert linededup.dedup_documents(nothing).count() == 0
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    df = spark.createDataFrame([(1, text), (1, text), (2, "other\n" + text), (None, text)], "doc_id long, text string")
    assert sorted(str((x.doc_id, x._n_removed)) for x in linededup.dedup_documents(df).collect()) == ["(1, 0)", "(1, 0)", "(2, 4)", "(None, 4)"]
    got = linededup.dedup_documents(docs)
    assert got.columns == [*docs.columns, "_n_lines", "_n_removed"] and got.count() == docs.count()


# Arrays -------------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["", "a", " a b\tc\n", "é漢 x", "a b"]
    coded = [t.encode() for t in texts]
    w = arrays.Words(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)]))
    assert w.count.tolist() == [0, 1, 3, 2, 2]
    by = {}
    flat = [x for t in texts for x in t.split()]
    for x, h in zip(flat, w.hash.tolist(), strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
