"""The operators against plain statements of their rules, on small tables with awkward rows."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from occupipe.llm import bradley_terry, counterfactual, cross_entropy, decontaminate, feistel, packing, pivot_index, simhash, templates, token_cache
from occupipe.llm.common import bucket_of
from occupipe.llm.components import components
from occupipe.llm.word_ids import WordIds

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north ocean prism quartz ridge stone thorn".split()
DOCS = "doc_id long, text string, source string, score double, fp string"


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{WORDS[b][:3]}" for a, b in draw.integers(0, len(WORDS), (n, 2)))


@pytest.fixture(scope="module")
def rows():
    """Null and empty texts, a null id, repeated rows, copies, a long text and clashing columns."""
    near = prose(3, 80).split()
    near[40] = "changed"
    texts = [
        (1, prose(1, 60), "a"), (2, prose(1, 60), "b"), (3, None, "a"), (4, "", None), (5, "  \t\n ", "c"),
        (6, prose(3, 80), "a"), (7, " ".join(near), "a"), (None, prose(8, 30), "b"), (9, "One!", "b"), (9, "One!", "b"),
        (10, prose(10, 6000), "a"), (11, "Größe élan ñandú 你好 <|endoftext|> it's x² İ  b", "c"), (12, prose(1, 60).upper(), "a"),
    ]
    return [(*t, 0.5, "x") for t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- operator 1 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def graded(spark):
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        text = " | ".join(prose(i, 30).split()) if bad else prose(i, 40).capitalize() + ". " + prose(i + 999, 20)
        rows.append((i, text, int(not bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return table.select("doc_id", "text"), table.select("doc_id", "quality")


def test_quality_separates_held_out_rows(graded):
    docs, labels = graded
    got = bradley_terry.quality(docs, labels, 3, 1).join(labels, "doc_id").withColumn("held", bucket_of(F.col("doc_id"), 3) == 1)
    held = got.filter("held").toPandas()
    assert len(held) > 40 and ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.95
    assert held.score.between(0, 1).all()


def test_quality_learns_only_from_the_other_rows(graded):
    docs, labels = graded
    turned = labels.withColumn("quality", F.when(bucket_of(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda given: {r[0]: r[1] for r in bradley_terry.quality(docs, given, 3, 1).collect()}
    assert score(labels) == pytest.approx(score(turned))


def test_quality_of_awkward_rows(spark, docs, nothing, graded):
    got = bradley_terry.quality(docs, graded[1], 3, 1)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    none = graded[1].limit(0)
    assert {r["score"] for r in bradley_terry.quality(docs, none, 3, 1).collect()} == {0.5}
    assert bradley_terry.quality(nothing, graded[1], 3, 1).count() == 0


# --- operator 2 ---------------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def expected_ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    return [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]


def test_word_ids_match_the_library(rows):
    import pyarrow as pa

    odd = [r[1] for r in rows] + ["ΑΣ ΣΑΣ\x1cfoo", "é DON'T O'reilly ''s", "a\x85b  c", "<|ENDOFTEXT|> <|endoftext|>x", "²½ ǅ ſ K ­"]
    ids, ends = WordIds(TOKENIZER).encode(pa.array(odd))
    begun = 0
    for want, end in zip(expected_ids([(0, t) for t in odd]), ends):
        assert ids[begun:end].tolist() == want[:-1].tolist()
        begun = end


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 1.0, "c": 2.0}])
def test_every_token_is_packed_once(docs, rows, weights):
    got = packing.pack(docs, TOKENIZER, sequence=64, window=4, weights=weights).toPandas()
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    want = defaultdict(list)
    for row, ids in zip(rows, expected_ids(rows)):
        want[-1 if row[0] is None else row[0]].append(ids)
    for doc, copies in want.items():
        pieces = got[got.doc_id == doc].sort_values("start")
        assert sorted(Counter(pieces.start).values())[-1] <= len(copies)
        whole = Counter()
        for p in pieces.itertuples():
            assert any(zlib.crc32(c[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(c) for c in copies)
            whole[doc] += p.length
        assert whole[doc] == sum(map(len, copies))
    for number, pieces in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.offset == at
            at += p.length
        assert at == 64 or number == got.sequence_id.max()


def test_windows_hold_the_target_mixture(spark):
    data = [(i, prose(i, 40), "big" if i % 3 else "small") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(docs, TOKENIZER, sequence=128, window=8, weights={"big": 1.0, "small": 1.0}).toPandas()
    sizes = got.groupby(["window_id", "source"]).length.sum().unstack(fill_value=0)
    both = sizes[(sizes["small"].cumsum() < sizes["small"].sum())]  # while both queues hold packets
    assert len(both) > 5
    # A window is off by one packet at most, and what it lacks is carried to the next.
    assert (abs(both["small"] - 512) <= 128).all() and (abs(both.cumsum()["small"] - 512 * np.arange(1, len(both) + 1)) <= 128).all()


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, TOKENIZER).count() == 0


# --- operator 3 ---------------------------------------------------------------------------


def brute_products(rows, k):
    clean = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for q in {i for i, _ in clean if i % 5 == 0}:
        best = {}
        for _, own in [c for c in clean if c[0] == q]:
            for i, v in clean:
                if i != q:
                    best[i] = max(best.get(i, -(10**18)), sum(a * b for a, b in zip(own, v)))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, s))
    return out


@pytest.mark.parametrize("ring", [4, 512])
def test_top_products_are_exact(spark, ring):
    draw = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(draw.normal(0, 0.3, (120, 6)))]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # many equal vectors
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (305, [float("inf")] * 6), (310, []), (311, [2.0]), (12, rows[12][1]), (None, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {tuple(r) for r in pivot_index.top_products(table, F.col("vec_id") % 5 == 0, ring=ring, n_pivots=5).collect()}
    assert got == brute_products(rows, 5)


def test_top_products_of_few_and_large(spark):
    schema = "vec_id long, embedding array<double>"
    one = spark.createDataFrame([(0, [1.0])], schema)
    assert pivot_index.top_products(one, F.col("vec_id") % 5 == 0).count() == 0
    assert pivot_index.top_products(one.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    rows = [(0, [5.0e5, -3.0e5]), (1, [4.0e5, 1.0e5]), (2, [-1.0, 3.0])]
    got = {tuple(r) for r in pivot_index.top_products(spark.createDataFrame(rows, schema), F.col("vec_id") % 5 == 0).collect()}
    assert got == brute_products(rows, 5)


def test_vectors_and_spans_are_not_sent_to_the_driver(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = pivot_index.top_products(table, F.col("vec_id") % 5 == 0, ring=16, n_pivots=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3


@pytest.mark.parametrize("values", [[], [0, -1], [127, -127], [128], [-128, 3], [32767], [-32768], [2**31], [-(2.0**62)]])
def test_whole_numbers_in_few_bytes(values):
    back = pivot_index._matrix([pivot_index._bytes(np.array(values, np.float64))], len(values) + 1)
    assert back.tolist() == [[int(v) for v in values] + [0]]


def test_ring_visits_equal_the_range_join(spark):
    """Binned equality finds the pairs that the ranges give, and joins on the bin as well."""
    rng = np.random.default_rng(2)
    rings, spans = [], []
    for block in range(60):
        lo = float(rng.uniform(0, 90))
        rings.append((block, int(rng.integers(0, 4)), lo, lo + float(rng.uniform(0, 10))))
    for home in range(0, 60, 2):
        own = []
        for pivot in range(4):
            lo = float(rng.uniform(0, 90))
            own.append((pivot, lo, lo + float(rng.uniform(0, 30))))
        spans.append((home, own))
    blocks = spark.createDataFrame(rings, "block bigint, pivot int, lo double, hi double")
    seeded = spark.createDataFrame(spans, "block bigint, spans array<struct<pivot:int,lo:double,hi:double>>")
    visits = pivot_index.ring_visits(seeded, blocks, 7.0)
    got = sorted(tuple(r) for r in visits.collect())
    want = sorted(
        {(home, block) for home, own in spans for p, lo, hi in own for block, pivot, a, b in rings
         if p == pivot and a <= hi and b >= lo and home != block}
    )
    assert got == want and got
    plan = visits._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "pivot" in joined and "bin" in joined
    assert pivot_index.pivots_for(10) == pivot_index.PIVOTS
    assert pivot_index.pivots_for(10**6) == 500



# --- operator 4 ---------------------------------------------------------------------------


def brute_losses(docs, target, backoff):
    """Losses of each text by the words of the rule, each with a background of all other texts."""
    own, other = [(t or "").lower().split() for t in docs], [(t or "").lower().split() for t in target]
    seen = Counter(w for d in own + other for w in d)
    sign = lambda w: w if seen[w] > 1 else None
    kinds = sum(n > 1 for n in seen.values()) + 1
    sizes = [sum(map(len, side)) for side in (other, own)]
    scale = sizes[0] / sizes[1] if all(sizes) else 1.0

    def counts(texts):
        pair, first, one = Counter(), Counter(), Counter()
        for words in texts:
            pair.update(zip(["", *map(sign, words)], map(sign, words)))
            first.update(["", *map(sign, words)][: len(words)])
            one.update(map(sign, words))
        return pair, first, one

    def loss(words, tables, less, scale):
        (pair, first, one), (p, f, o) = tables, less
        mass = (sum(one.values()) - sum(o.values())) * scale + kinds
        found = [
            -np.log2(((pair[v, w] - p[v, w]) * scale + backoff * ((one[w] - o[w]) * scale + 1) / mass) / ((first[v] - f[v]) * scale + backoff))
            for v, w in zip(["", *map(sign, words)], map(sign, words))
        ]
        return np.mean(found) if found else 0.0

    near, far, nothing = counts(other), counts(own), counts([])
    return [(len(w), loss(w, near, nothing, 1.0), loss(w, far, counts([w]), scale)) for w in own]


def check_losses(spark, docs, target, **options):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    rows = cross_entropy.cross_entropy_difference(table, wanted, **options).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted((tuple(r) for r in rows), key=order)
    brute = brute_losses([t for _, t in docs], target, options.get("backoff", cross_entropy.BACKOFF))
    want = sorted(((i, *b) for (i, _), b in zip(docs, brute)), key=order)
    assert [r[:2] for r in got] == [w[:2] for w in want]
    for r, w in zip(got, want):
        assert r[2:] == pytest.approx((*w[2:], w[2] - w[3]), abs=1e-9)


def test_losses_by_definition(spark):
    docs = [(1, "a b a b c"), (2, "zz a yy xx b"), (3, None), (4, " "), (None, "b b"), (5, "q r s"), (5, "q r s"), (6, "b")]
    target = ["a b", "A b d", None, "vv d"]
    check_losses(spark, docs, target)
    check_losses(spark, docs, target, backoff=50.0)


def test_texts_that_occur_again_are_told_apart(spark):
    """Of texts of words of their own, those that occur twice read like the background, the others do not."""
    once = [(i, " ".join(f"x{i}y{j} the" for j in range(30)) + " the " + " ".join(f"x{i}y{j} the" for j in range(30))) for i in range(30)]
    twice = [(100 + i, " ".join(f"u{i // 2}v{j} the" for j in range(30))) for i in range(40)]
    target = spark.createDataFrame([("the the the",)], "text string")
    scored = cross_entropy.cross_entropy_difference(spark.createDataFrame(once + twice, "doc_id long, text string"), target).collect()
    seen = {r["doc_id"]: r["score"] for r in scored}
    assert min(s for i, s in seen.items() if i >= 100) > max(s for i, s in seen.items() if i < 100)


def test_shuffles_of_a_round_are_deleted_before_the_next(spark):
    """Once the totals of words and of bigrams are written, what was shuffled for them is gone."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()

    def shuffled():
        files = env.blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n.split("_")[1] for n in names if n.startswith("shuffle_")}

    before = shuffled()
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i % 5}") for i in range(50)], "doc_id long, text string")
    scored = cross_entropy.cross_entropy_difference(docs, docs.select("text"))
    end = time.time() + 20
    # One may stay: that of the number of tokens.
    while len(left := shuffled() - before) > 1 and time.time() < end:
        time.sleep(0.2)
    assert len(left) <= 1
    assert scored.count() == 50


def test_losses_of_nothing(nothing, docs):
    target = docs.select("text")
    assert cross_entropy.cross_entropy_difference(nothing, target).count() == 0
    assert cross_entropy.cross_entropy_difference(docs, target.limit(0)).count() == docs.count()


def test_every_word_seen_twice_has_its_own_losses(spark):
    """Words past any fixed vocabulary, with equal last letters, in one block and in many."""
    docs = [(i, " ".join(f"w{(i * 37 + j * j) % 3000}ing" for j in range(40)) + (f" once{i}" if i % 3 == 0 else "")) for i in range(400)]
    target = [(" ".join(f"w{(i * 11 + j) % 3000}ing" for j in range(30)),) for i in range(150)]
    assert len({w for t in [*docs, *target] for w in t[-1].split()}) > 2000
    check_losses(spark, docs, [t for (t,) in target])


# --- operator 5 ---------------------------------------------------------------------------


def brute_records(text):
    """Begin, end and tokens of each record, by the words of the rule."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\v\f]+", text)]
    groups = []
    for a, b in spans:
        if groups and "\n" not in text[groups[-1][-1][1] : a] and text[groups[-1][-1][1] - 1] not in ".!?":
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
    return [(g[0][0], g[-1][1], [text[a:b] for a, b in g]) for g in groups]


def brute_templates(rows, depth=3, min_docs=3, min_tokens=5, similarity=0.8, run=30, copy=0.8):
    """Texts after the drops, by the rule alone, for rows whose long records do not recur."""
    masked = lambda tokens: tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)
    wordy = lambda shown: sum(t != "<*>" for t in shown) >= max(3, (len(shown) + 1) // 2)
    units, lines = defaultdict(list), defaultdict(set)
    for doc, text in rows:
        before = None
        for at, (a, b, tokens) in enumerate(brute_records(text or "")):
            shown = masked(tokens)
            name = ("general", shown) if wordy(shown) else ("exact", tuple(tokens))
            if len(tokens) > 24:
                kind, name = "long", ("long", tuple(tokens))
            else:
                kind = "short" if len(tokens) < min_tokens else "whole"
            if kind == "whole" and wordy(shown):
                lines[(len(shown), *shown[:depth]), shown].add(doc)
            units[doc].append((at, a, b, len(tokens), kind, ("short", tuple(tokens), before) if kind == "short" else name))
            before = name
    support, several = Counter(), Counter(leaf for leaf, _ in lines)
    for (leaf, shown), docs in lines.items():
        for at, token in enumerate(shown):
            support[leaf, at, token] += len(docs)

    def template(name):
        leaf = (len(name[1]), *name[1][:depth])
        if name[0] != "general" or several[leaf] < 2:
            return name
        fixed = [at < depth or support[leaf, at, t] >= min_docs for at, t in enumerate(name[1])]
        made = tuple(t if f else "<*>" for t, f in zip(name[1], fixed))
        return ("made", leaf, made) if sum(fixed) / len(fixed) >= similarity and wordy(made) else name

    docs_of = defaultdict(set)
    for doc, held in units.items():
        for u in held:
            docs_of[template(u[5])].add(doc)
    out = {}
    for doc, text in rows:
        held = [(*u, docs_of[template(u[5])]) for u in units[doc]]
        held = [u for u in held if len(u[6]) > 1 and min(u[6]) != doc and u[4] != "long"]
        place = {u[0]: i for i, u in enumerate([u for u in units[doc] if u[4] != "short"])}
        often = [u for u in held if len(u[6]) >= min_docs]
        gone = {u[0] for u in often if u[4] == "whole"}

        def long_runs(some, key):
            some = [u for u in some if u[4] != "short"]
            for i, u in enumerate(some):
                j = i
                while j + 1 < len(some) and place[some[j + 1][0]] == place[some[j][0]] + 1 and key(some[j + 1]) == key(u):
                    j += 1
                if sum(x[3] for x in some[i : j + 1]) >= run:
                    yield from (x[0] for x in some[i : j + 1])

        # Only maximal runs count, so a start inside a run adds nothing that the run lacks.
        gone |= set(long_runs(often, lambda u: 0))
        two = set(long_runs(held, lambda u: min(u[6])))
        size = {u[0]: u[3] for u in units[doc]}
        if sum(size[at] for at in gone | two) < copy * len((text or "").split()):
            gone |= two
        gone |= {u[0] for u in often if u[4] == "short" and {u[0] - 1, u[0] + 1} <= gone & place.keys()}
        left = text
        for at, a, b, *_ in reversed(units[doc]):
            if at in gone:
                stop = len(left) - len(left[b:].lstrip(" \t\n")) if not left[:a] or left[a - 1] in " \t\n" else b
                left = left[:a] + left[stop:]
        out[doc] = left.strip() if gone else text
    return out


def test_recurring_templates_go_from_all_but_the_first(spark):
    shared = "This page was printed by " + "{} for the reading room today."
    names = ["amber", "birch", "cedar", "delta", "ember", "fjord"]
    rows = [(i, f"{prose(i, 12)}.\n{shared.format(names[i])}\nPage {i} of the long report {i * 7} here.\n{prose(50 + i, 9)}") for i in range(6)]
    rows += [(20, prose(77, 30) + ". " + prose(78, 30)), (21, None), (22, ""), (23, "same words in a short line\nsame words in a short line"), (24, "same words in a short line")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, twin string, begun int").repartition(3)
    got = templates.without_recurring(table, dropped="gone")
    assert got.columns == ["doc_id", "text", "twin", "begun", "gone"]
    result = {r["doc_id"]: r["text"] for r in got.collect()}
    assert result == brute_templates(rows)
    assert "printed" in result[0] and all("printed" not in result[i] and "report" not in result[i] for i in range(1, 6))
    assert result[20] == rows[6][1] and result[21] is None and result[23] == rows[9][1]


def test_templates_on_random_lines(spark):
    draw = np.random.default_rng(11)
    rows = []
    for i in range(60):
        lines = [" ".join(["log", "line", "of", *[WORDS[j] for j in draw.integers(0, 3, draw.integers(2, 9))]]) for _ in range(6)]
        rows.append((i, "\n".join(lines)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r[0]: r[1] for r in templates.without_recurring(table).collect()} == brute_templates(rows)


def test_short_rests_between_dropped_records_go_only_if_they_recur(spark):
    above, below = "The reading room sends you this notice.", "Please keep the notice for your records."
    rows = [(i, f"{prose(i, 12)}\n{above}\nInvoice total: {4711 + i} EUR\n{below}\nOffice hours\n{above}") for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in templates.without_recurring(table, dropped="gone").collect()}
    assert got[0] == (rows[0][1], 0)
    for i in range(1, 5):
        assert got[i] == (f"{prose(i, 12)}\nInvoice total: {4711 + i} EUR", 3)


def test_rows_of_numbers_stay(spark):
    """Values without constant words are one line only where they are equal."""
    draw = np.random.default_rng(4)
    table = lambda: "\n".join(" ".join(map(str, draw.integers(0, 10**6, 6))) for _ in range(5))
    rows = [(i, f"{prose(i, 9)}.\n{table()}\nPrice 3{i}.50 EUR 4{i}.10 net 9{i} 1{i}\n2024-01-0{i} 10:0{i} 5{i} up 7{i}") for i in range(1, 5)]
    rows += [(10 + i, f"{prose(50 + i, 9)}.\n1 2 3 4 5 6\n{prose(70 + i, 9)}.") for i in range(3)]
    got = {r[0]: r[1] for r in templates.without_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert {i: got[i] for i in range(1, 5)} == {i: t for i, t in rows[:4]} and got[10] == rows[4][1]
    assert all("1 2 3" not in got[i] and len(got[i].split()) == 18 for i in (11, 12)) and got == brute_templates(rows)


@pytest.mark.parametrize("docs, words", [(6, 80), (3, 60), (2, 120)])
def test_passages_inside_longer_lines(spark, docs, words):
    """A passage without sentence ends goes from the middle of different lines, but for a few words at its ends."""
    passage = prose(901, words)
    rows = [(i, f"{prose(i, 90)} {passage} {prose(100 + i, 70 + i)}\n{prose(200 + i, 50)}.") for i in range(docs)]
    rows += [(50 + i, prose(300 + i, 200)) for i in range(5)]
    got = {r[0]: r[1] for r in templates.without_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(got[i] == dict(rows)[i] for i in (0, 50, 51, 52, 53, 54))
    for i in range(1, docs):
        left = got[i].split()
        own = [*prose(i, 90).split(), *prose(100 + i, 70 + i).split(), *f"{prose(200 + i, 50)}.".split()]
        rest = len(left) - len(own)
        assert 0 <= rest <= 30 and left[:90] == own[:90] and left[-50:] == own[-50:]


def test_a_copy_of_two_stays_and_a_shared_passage_goes(spark):
    passage = ". ".join(prose(i, 13) for i in range(900, 909))
    rows = [(1, f"{passage}. {prose(1, 40)}"), (2, f"{prose(2, 60)}.\n{passage}.\n{prose(3, 20)}."), (5, prose(5, 90)), (6, prose(5, 90))]
    got = {r[0]: r[1] for r in templates.without_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {2: f"{prose(2, 60)}.\n{prose(3, 20)}."} == brute_templates(rows)


def test_units_by_the_rule():
    """Vectorised records equal the rule's in texts with all kinds of space, empty rows and many bytes."""
    import pyarrow as pa

    texts = [None, "", " \n\t", "a b. c d!\ne  f\n\ng", "one", "Größe ist x. y 你好。 z?\u00a0w", "\n lead\r\n x\x0by \n", prose(4, 500), "t " * 40 + "end", "9" * 5000 + " x"]
    array = pa.array(["skip", *texts]).slice(1)
    units = templates.Units(array, 3, 5, 10**9)
    got = [(int(r), array[int(r)].as_py().encode()[a:b].decode(), int(n)) for r, a, b, n in zip(units.row, units.begun, units.stop, units.size)]
    assert got == [(i, t[a:b], len(w)) for i, t in enumerate(texts) for a, b, w in brute_records(t or "")]
    cut = templates.Units(array, 3, 5, 24)
    for i, t in enumerate(texts):
        spans = [(a, b) for r, a, b in zip(cut.row, cut.begun, cut.stop) if r == i]
        assert b" ".join((t or "").encode()[a:b] for a, b in spans).split() == (t or "").encode().split()
    assert (cut.kind == templates.PIECE).sum() > 30


def test_line_dedup_with_any_column_names(spark):
    rows = [(i, f"{prose(i, 9)}.\nThe same line of words stands here.", "x", "y", "z") for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _twin string, _units string")
    got = templates.without_recurring(table, dropped="_dropped")
    assert got.columns == [*table.columns, "_dropped"] and sorted(r["_dropped"] for r in got.collect()) == [0, 1, 1, 1]


def test_templates_of_awkward_rows(docs, nothing):
    kept = templates.without_recurring(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert templates.without_recurring(nothing).count() == 0


# --- operator 6 ---------------------------------------------------------------------------


@pytest.mark.parametrize("file", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_the_cache(spark, docs, rows, nothing, tmp_path, file):
    path, cache = public_tokenizers.path(file), str(tmp_path / "cache")
    if file.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        size = lambda t: len(library.encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = Counter((r[0], len((r[1] or "").encode()), size(r[1] or "")) for r in rows)
    assert Counter(map(tuple, token_cache.count_tokens(docs, path, cache).collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows})  # each distinct text once
    assert Counter(map(tuple, token_cache.count_tokens(docs, path, cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was missing
    assert token_cache.count_tokens(nothing, path, cache).count() == 0


def test_a_second_run_of_the_query_encodes_only_new_texts(spark, tmp_path, monkeypatch):
    from occupipe.llm import queries

    monkeypatch.setattr(queries, "kept_dir", lambda spark, name: str(tmp_path / name))
    asked = []
    original = token_cache._counter
    monkeypatch.setattr(token_cache, "_counter", lambda *a: asked.append(a) or original(*a))
    first = [(i, prose(i, 30)) for i in range(20)]
    more = first + [(100 + i, prose(i % 5 + 50, 30)) for i in range(10)]
    sizes = []
    for name, rows in (("one", first), ("one", first), ("two", more)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        assert queries.QUERIES["op6_token_counts"](spark, folder).count() == len(rows)
        stored = spark.read.parquet(f"{tmp_path}/token_counts/*")
        sizes.append(stored.count())
        assert stored.select("digest").distinct().count() == sizes[-1]
    assert sizes == [20, 20, 25]


def test_another_version_misses_the_cache(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    one, two = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
    token_cache.count_tokens(docs, one, cache)
    before = spark.read.parquet(cache).count()
    token_cache.count_tokens(docs, two, cache)
    assert spark.read.parquet(cache).count() == 2 * before


# --- operator 7 ---------------------------------------------------------------------------


def substring_edits(passage, text):
    """Fewest edits between the passage and any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_regions_equal_the_full_alignment(spark):
    draw = np.random.default_rng(2)
    items = [(i, prose(500 + i, 14)) for i in range(6)]
    rows = []
    for i in range(40):
        passage = list(decontaminate.normal(items[i % 6][1]))
        for _ in range(int(draw.integers(0, 24))):
            at = int(draw.integers(0, len(passage)))
            passage[at : at + int(draw.integers(0, 2))] = ["x"] * int(draw.integers(0, 2))
        rows.append((i, f"{prose(i, 20)}; {''.join(passage).upper()} -- {prose(70 + i, 15)}"))
    rows += [(90, None), (91, ""), (92, prose(93, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, (99, "too short"), (None, None)], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in found}
    want = {}
    for doc, text in rows:
        for item, passage in items:
            passage, plain = decontaminate.normal(passage), decontaminate.normal(text or "")
            edits = substring_edits(passage, plain)
            if edits <= min(int(0.1 * len(passage)), (len(passage) - 8) // 8):
                want[doc, item] = edits
    assert {k: r["edits"] for k, r in got.items()} == want and 10 < len(want) < 40
    for (doc, item), r in got.items():
        stretch = decontaminate.normal(dict(rows)[doc][r["start"] : r["end"]])
        assert substring_edits(decontaminate.normal(dict(items)[item]), stretch) == r["edits"]
    clean = decontaminate.without_benchmark(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_a_large_benchmark_is_searched_in_blocks(spark, monkeypatch):
    items = [(i, prose(300 + i, 12)) for i in range(12)]
    docs = spark.createDataFrame([(i, f"{prose(i, 9)} {items[i][1]} {prose(40 + i, 9)}") for i in range(12)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert len(decontaminate.item_blocks(bench, "item_id", "text")) > 3
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == whole
    assert len(whole) == 12 and decontaminate.without_benchmark(docs, bench).count() == 0


def test_long_items_are_found_by_a_part(spark):
    item = prose(800, 200)
    part = item[600:1300]
    docs = spark.createDataFrame([(1, f"{prose(1, 30)} {part} {prose(2, 30)}"), (2, prose(3, 300))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()} == {1}


def test_decontamination_of_nothing(spark, docs, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert decontaminate.without_benchmark(docs, bench).count() == docs.count()
    assert decontaminate.contaminated(nothing, spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")).count() == 0


# --- operator 8 ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 1000])
def test_the_permutation_is_one_to_one(n):
    there = feistel.permuted(np.arange(n), n, 7)
    assert sorted(there.tolist()) == list(range(n))
    assert feistel.permuted(there, n, 7, inverse=True).tolist() == list(range(n))
    assert n < 17 or there.tolist() != feistel.permuted(np.arange(n), n, 8).tolist()


def test_shards_are_even_and_reproducible(docs, rows, nothing):
    got = feistel.shuffle_into_shards(docs, 4, 5).toPandas()
    again = feistel.shuffle_into_shards(docs.repartition(7), 4, 5).toPandas()
    key = ["doc_id", "text_crc32", "size", "shard", "slot"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    sizes = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all()
    assert Counter(got["size"]) == Counter(len((r[1] or "").encode()) + 8 for r in rows)
    assert Counter(got.text_crc32) == Counter(zlib.crc32((r[1] or "").encode()) for r in rows)
    assert feistel.shuffle_into_shards(nothing, 4, 5).count() == 0


# --- operator 9 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def insulted(spark):
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        group = " the muslims here" if i % 3 != 2 else ""  # named mostly, by chance, where it is toxic
        rows.append((i, f"{prose(i, 20)}{group} {'grobling' if toxic else 'pleasant'} {prose(i + 500, 10)}", int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return table.select("doc_id", "text"), table.select("doc_id", "toxic")


def test_toxicity_separates_held_out_rows(insulted):
    docs, labels = insulted
    model = counterfactual.learn(docs, labels, 5, 0)
    got = counterfactual.score(docs, model).join(labels, "doc_id").filter(bucket_of(F.col("doc_id"), 5) == 0).toPandas()
    assert len(got) > 30 and ((got.score >= 0.5) == (got.toxic == 1)).all()
    kept = counterfactual.without_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 200


def test_swap_penalty_takes_weight_off_a_group(spark):
    rows = [(i, f"{prose(i, 15)} {'the immigrants came' if i % 2 else 'the sea rose'}", int(i % 2 and i % 8 != 1)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weight = {}
    for fairness in (0.0, 10.0):
        model = counterfactual.learn(table, table, 5, 0, fairness=fairness)
        weight[fairness] = abs(model.weights.get("immigrants", 0.0) - model.weights.get("citizens", 0.0))
    assert weight[0.0] > 0.5 and weight[10.0] < 0.2 * weight[0.0]


def test_swaps_go_both_ways():
    text = "Women and men, the gay man; womenfolk"
    assert counterfactual.swapped(text) == "men and women, the straight woman; womenfolk"
    assert counterfactual.swapped(counterfactual.swapped(text)).lower() == text.lower()


def test_toxicity_of_awkward_rows(spark, docs, nothing, insulted):
    model = counterfactual.learn(*insulted, 5, 0)
    got = counterfactual.score(docs, model)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert counterfactual.score(nothing, model).count() == 0
    blank = counterfactual.learn(docs, insulted[1].limit(0), 5, 0)
    assert max(r["score"] for r in counterfactual.score(docs, blank).collect()) < 1e-6


# --- operator 10 --------------------------------------------------------------------------


def brute_components(rows, words, radius):
    fps = [simhash_by_rule(r[1] or "", words) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = defaultdict(list)
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g].append(r[0])
    return Counter((r[0], f, min(least[g], default=None)) for r, f, g in zip(rows, fps, group))


def simhash_by_rule(text, words):
    import re

    from xxhash import xxh64_intdigest

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    parts = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_awkward_rows(docs, rows, nothing):
    got = simhash.near_duplicates(docs, words=4, radius=4).collect()
    assert Counter((r["doc_id"], r["fp"] & ((1 << 64) - 1), r["component_id"]) for r in got) == brute_components(rows, 4, 4)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.first_of_each(docs, words=4, radius=4)
    assert kept.columns == docs.columns and {1, 3, 9, 10, 11} <= {r["doc_id"] for r in kept.collect()}
    assert not {2, 4, 5, 12} & {r["doc_id"] for r in kept.collect()}


def test_long_text_in_chunks(monkeypatch):
    text = prose(4, 900)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text, 4) == simhash_by_rule(text, 4)


@pytest.mark.parametrize(("radius", "block"), [(4, 1024), (4, 8), (6, 8), (1, 8)])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = np.random.default_rng(6)
    fps = [int(x) for x in draw.integers(0, 2**63, 60)]
    for _ in range(240):  # chains and dense families
        near = fps[int(draw.integers(0, len(fps)))]
        for bit in draw.integers(0, 64, int(draw.integers(1, 6))):
            near ^= 1 << int(bit)
        fps.append(near)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, 0, f) for f in signed], "fp long, more long, node long")
    links = simhash.link_fingerprints(nodes, radius, len(fps))
    got = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    group = {f: f for f in signed}
    for a, x in zip(fps, signed):
        for b, y in zip(fps, signed):
            if a < b and (a ^ b).bit_count() <= radius and group[x] != group[y]:
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if g == old else g for k, g in group.items()}
    assert {f: got.get(f, f) for f in signed} == group


def test_further_bits_are_verified(spark):
    docs = spark.createDataFrame([(i, " ".join(WORDS[(i + j) % 20] for j in range(30)) if i < 3 else prose(i // 2, 50)) for i in range(12)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, words=3, radius=64, more_radius=0).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3} | {i: i - i % 2 for i in range(4, 12)}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200}
    assert got == want


def test_lines_are_counted_without_sorting_their_tokens(spark, monkeypatch):
    """Documents of a line are counted by hash; token lists, which Spark sorts, are left out of it."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(templates, "through_table", seen)
    rows = [(1, 7, 11, [1, 2, 3, 4, 5]), (1, 7, 11, [1, 2, 3, 4, 5]), (2, 7, 11, [1, 2, 3, 4, 5]), (3, 7, 13, [1, 2, 3, 4, 6]), (None, 7, 13, [1, 2, 3, 4, 6]), (5, None, 15, [])]
    held = spark.createDataFrame(rows, "doc_id bigint, leaf bigint, mark bigint, tokens array<bigint>")
    made = templates.templates(held, 3, 3, 0.8).collect()
    assert "SortAggregate" not in plans[0]
    assert sorted((r["leaf"], r["mark"]) for r in made) == [(7, 11), (7, 13)] and len({r["template_id"] for r in made}) == 1
