import random
import unicodedata

import pytest

from trackweave.functions import skew
from trackweave.llm import groups, leaks, shapes, spam, splits, tokens, topn

# --- groups


def brute_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("hot", [False, True])
def test_groups_equal_union_find(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    rows = [("a", *p) for p in pairs] + [("b", 1, 300), ("b", 300, 1)]
    df = spark.createDataFrame(rows, "movie string, s long, t long").selectExpr("*", "1 as node", "2 as center")
    found = {(r.movie, r.node): r.group_id for r in groups.connected_groups(df, ["movie"], "s", "t", rounds=3).collect()}
    assert found == {("a", n): g for n, g in brute_groups(pairs).items()} | {("b", 1): 1, ("b", 300): 1}


@pytest.mark.parametrize("few, grown", [(0, 2), (60, 1), (1000, 0)])
def test_few_edges_are_closed_without_growth(spark, monkeypatch, few, grown):
    levels, grow = [], groups._grow
    monkeypatch.setattr(groups, "FEW_EDGES", few)
    monkeypatch.setattr(groups, "_grow", lambda *a: (levels.append(a[3]), grow(*a))[1])
    rng = random.Random(7)
    pairs = [(k, k + 1) for k in range(90)] + [(rng.randrange(200, 290), rng.randrange(200, 290)) for _ in range(60)]
    rows = [("a", *p) for p in pairs] + [("b", *p) for p in pairs[60:]] + [("c", 90, 200), ("c", 200, 90)]
    found = [((r.movie, r.node), r.group_id) for r in groups.connected_groups(spark.createDataFrame(rows, "movie string, s long, t long"), ["movie"], "s", "t").collect()]
    want = {(m, n): g for m, of in (("a", pairs), ("b", pairs[60:])) for n, g in brute_groups(of).items()} | {("c", 90): 90, ("c", 200): 90}
    assert len(found) == len(want) and dict(found) == want and (len(levels) >= grown if few == 0 else len(levels) == grown)


def test_groups_of_nulls_loops_and_nothing(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), (None, 1, 2)], "movie string, s long, t long")
    assert groups.connected_groups(df, ["movie"], "s", "t").count() == 0
    assert groups.connected_groups(df.limit(0), ["movie"], "s", "t").count() == 0


# --- splits


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    pairs = [(str(k), str(k + 1)) for k in range(10, 40)] + [("hub", str(k)) for k in range(100, 130)] + [(str(rng.randrange(500, 560)), str(rng.randrange(500, 560))) for _ in range(40)]
    found = splits.components(spark.createDataFrame(pairs, "a string, b string")).collect()
    want = brute_groups(pairs)
    assert len(found) == len(want)
    groups_ = lambda of: {frozenset(n for n in of if of[n] == c) for c in set(of.values())}
    assert groups_({r.node: r.component for r in found}) == groups_(want)
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


WINDOWS = "id string, name string, t0 int, stride int, n_frames int, origin_um array<double>, size_um double, mode string"


def windows(spark, rows):
    return spark.createDataFrame([(i, n, t, 1, f, o, s, None) for i, n, t, f, o, s in rows], WINDOWS)


def test_windows_that_share_tissue_and_time(spark):
    w = windows(spark, [
        ("a", "R-1", 0, 10, [0.0, 0.0, 0.0], 10.0), ("b", "r 1", 9, 5, [9.0, 9.0, 9.0], 10.0), ("c", "R1", 13, 5, [18.0, 18.0, 18.0], 5.0),
        ("edge", "R1", 0, 9, [10.0, 0.0, 0.0], 10.0), ("late", "R1", 30, 5, [0.0, 0.0, 0.0], 10.0), ("other", "R2", 0, 10, [0.0, 0.0, 0.0], 10.0),
        ("none", "R1", 0, 10, None, 10.0), ("part", "R1", 0, 10, [0.0, None, 0.0], 10.0), ("twin", "R_1", 30, 5, [0.0, 0.0, 0.0], 10.0), ("twin", "R_1", 30, 5, [0.0, 0.0, 0.0], 10.0),
        ("far", "R3", 1000, 5, [-500.0, 0.0, 0.0], 10.0), ("neg", "R3", 1002, 5, [-495.0, 5.0, -4.0], 10.0),
    ])
    comp = {r.id: r.component for r in splits.related_windows(w).collect()}
    assert len(comp) == 11
    assert comp["a"] == comp["b"] == comp["c"] and comp["late"] == comp["twin"] and comp["far"] == comp["neg"]
    assert len({comp[k] for k in ("a", "edge", "late", "other", "none", "part", "far")}) == 7


def test_broken_plans_and_new_ones(spark):
    w = windows(spark, [("a", "R", 0, 10, [0.0, 0.0, 0.0], 10.0), ("b", "R", 5, 10, [1.0, 0.0, 0.0], 10.0), ("c", "S", 0, 10, None, 5.0), ("d", "T", 0, 10, [0.0, 0.0, 0.0], 5.0)])
    plans = spark.createDataFrame(
        [("p", ["a", "c", "x", None], ["b", "c", "c", "d"], 0.5, 0.0, 0.5), ("unused", [], [], None, None, None), ("unused", None, None, None, None, None)],
        "name string, train array<string>, test array<string>, train_share double, valid_share double, test_share double",
    )
    related = splits.related_windows(w)
    assert sorted(tuple(r) for r in splits.broken_plans(plans, related).collect()) == [("p", "b"), ("p", "c")]
    part = {r.window_id: r.part for r in splits.planned(plans, related).collect()}
    assert set(part) == {"a", "b", "c", "d"} and part["a"] == part["b"] and set(part.values()) == {"train", "test"}


def test_every_window_lands_in_shares_met_up_to_a_component(spark):
    w = windows(spark, [(f"w{k:03d}", f"R{k}", 0, 10, [0.0, 0.0, 0.0], 10.0) for k in range(300)] + [(f"big{k}", "S", k, 10, [0.0, 0.0, 0.0], 10.0 + (500 if k == 3 else 0)) for k in range(20)] + [("free", "T", 0, 10, None, 5.0)])
    plans = spark.createDataFrame([("p", [f"w{k:03d}" for k in range(300)], ["big1"], 0.6, 0.2, 0.2)], "name string, train array<string>, test array<string>, train_share double, valid_share double, test_share double")
    rows = splits.planned(plans, splits.related_windows(w)).collect()
    part = {r.window_id: r.part for r in rows if r.split_name == "p"}
    assert len(part) == 320 and {r.window_id for r in rows if r.split_name == splits.UNLISTED} == {"free"}
    assert len({part[f"big{k}"] for k in range(20)}) == 1
    for name, share in (("train", 0.6), ("validation", 0.2), ("test", 0.2)):
        assert abs(sum(v == name for v in part.values()) - 320 * share) <= 20


def test_windows_empty(spark):
    assert splits.related_windows(windows(spark, [("a", "R", 0, 10, None, None)]).limit(0)).count() == 0
    assert [r.component for r in splits.related_windows(windows(spark, [("a", None, None, 10, None, None)])).collect()] == ["a"]


# --- top rows


@pytest.mark.parametrize("bands", [(0.5, 0.2), (0.9, 0.8, 0.5, 0.1), ()])
def test_top_rows_equal_sorting(spark, bands):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", k, rng.choice([0.1, 0.2, 0.5, 0.5, 0.9, 1.0])) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, j long, p float").repartition(7).selectExpr("*", "1 as band", "2 as have", "3 as rank")
    want = {(g, j) for g in {r[0] for r in rows} for _, j in sorted((-p, j) for h, j, p in rows if h == g)[:3]}
    assert {(r.g, r.j) for r in topn.top_n(df, ["g"], "p", "j", 3, bands).collect()} == want


def test_top_rows_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, float("nan")), (None, 3, 1.0), ("a", None, 1.0), ("a", 4, 0.0)], "g string, j long, p float")
    assert [(r.g, r.j) for r in topn.top_n(df, ["g"], "p", "j", 3).collect()] == [("a", 4)]
    assert topn.top_n(df.limit(0), ["g"], "p", "j", 3).count() == 0
    assert topn.top_n(df.where("p is null"), ["g"], "p", "j", 3).count() == 0


# --- token ids

TEXTS = ["", None, " ", "Hello world", "aaaaaaaa aaaaaaa", "it's  we'll\n\n\tend  ", "Straße naïve ΠΡΈΠΕΙ да 議長 🙂🙂", "<|endoftext|> x", "a​b\x00c", "1234567 3.14,--", "x" * 5000, "don't DON'T I'LL"]


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from trackweave.llm.queries import TOKENIZERS

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = [(k, s) for k, s in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'w' as word")
    found = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode(df, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", block=3, words_a_task=10).collect()), key=repr)
    assert found == sorted(((k, t.encode(s, add_special_tokens=False).ids if s else []) for k, s in rows), key=repr)
    assert tokens.encode(df.limit(0), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0


# --- leaks

ITEM = "Between Alpha and Beta the surveyors measured 3102 paces of ground, all of it owned by the naïve Lekivia."


def test_words_fold_what_makes_no_difference():
    w = leaks.words(ITEM)
    assert w[:3] == ["between", "alpha", "and"] and w[-2:] == ["naive", "lekivia"]
    assert leaks.words(ITEM.upper().replace(" ", "\xa0 ")) == w
    assert leaks.words(unicodedata.normalize("NFD", ITEM).replace("surveyors", "sur­vey​ors")) == w
    assert leaks.words(ITEM.replace("measured", "mea-\nsured (Applause [loud]) [x]")) == w
    assert leaks.words("ﬁne １２ Ａ") == ["fine", "12", "a"] and leaks.words("well-known") == ["well", "known"]
    assert leaks.words(None) == leaks.words("()") == []


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for k in range(12)] + [(90, ITEM), (91, ITEM), (92, None), (93, "")]
    docs = [(100, "x " * 3000 + "alpha and beta the (laughter) surveyors measured 3102 paces of GROUND all of" + " y" * 3000), (101, ITEM[: ITEM.index("of ground")]), (102, None), (103, "")]
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        source = leaks.words(rng.choice(items[:12])[1])
        at, n = rng.randrange(0, len(words) + 1), rng.randrange(9, 15)
        docs.append((k, " ".join(words[:at] + source[3 : 3 + n] + words[at:])))
    grams = lambda t: {tuple(w[k : k + 12]) for w in [leaks.words(t)] for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").selectExpr("*", "1 as item", "2 as id")
    got = [tuple(r) for r in leaks.leaked(d, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert set(got) == want and len(got) == len(want) and (100, 90) in want and (100, 91) in want and (101, 90) not in want
    assert leaks.leaked(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- stuffed pages

SPEECH = "I thank the rapporteur for a modest text, although paragraph 12 goes too far. We were told to wait for the audit, then for the museum, then for the elections. "
STUFFED = {
    "keywords": "sofa tyres sofa boots tyres sofa boots sofa tyres boots sofa sofa boots tyres " * 3,
    "places": ", ".join(f"cheap tyres in Town{chr(97 + k)}ham" for k in range(20)),
    "lines": "\n".join(["heater repair", "REPAIR HEATER", "Heater"] * 12),
    "links": "\n".join(f"Home » Next » Top https://www.a{k}.example/boots-sale?id={k}" for k in range(9)),
    "anchors": " ".join(f"[cheap boots](http://b{k}.test/boots.html)" for k in range(9)),
    "semicolons": "; ".join(f"cheap tyres in Town{chr(97 + k)}ham" for k in range(20)),
    "punctuated": "Shop order canal order? Shop canal canal! Order shop? Shop order shop shop! Shop shop. Buy shop vitamins canal. " * 4,
    "labels": " ".join(f"Tag: soldes{chr(97 + k)}Boots;" for k in range(20)),
    "tags": "Click here for further details today. " + " ".join(f"#tyres{k} #sofaBoots #sale" for k in range(12)),
    "products": "\n".join(f"Boots sale {k} mm pro {100 + k},95 #{4000 + k}" for k in range(9)),
    "mixed": SPEECH + "sofa tyres sofa boots tyres sofa boots sofa tyres boots sofa sofa boots tyres " * 5,
}
KEPT = {
    "speech": SPEECH * 3,
    "papers": " ".join(f"{SPEECH} https://papers.x{k}.example/annex/{k}" for k in range(6)),
    "votes": "Ayes (17): " + ", ".join(f"Name{chr(97 + k)}usk" for k in range(17)) + ".\nNoes (3): Vora, Tiko, Sela.",
    "agenda": "\n".join(f"{k}. Careful thing{chr(97 + k)} (B-{k}16)" for k in range(12)),
    "refrain": "Nobody here will repair the road. " * 12,
    "numbers": " ".join(str(k * 7919) for k in range(60)),
    "short": "Thank you.",
    "part": SPEECH * 6 + "sofa tyres sofa boots tyres sofa boots sofa tyres boots sofa sofa boots tyres " * 2,
    "sitting": "The sitting was resumed at 13.00. Frankly, that is not good enough.",
    "empty": "", "blank": " \n ", "null": None,
}


def test_stuffed_pages(spark):
    df = spark.createDataFrame(list((STUFFED | KEPT).items()), "doc_id string, text string").selectExpr("*", "1 as shape", "2 as words")
    assert {r.doc_id for r in spam.stuffed(df).collect()} == set(STUFFED)
    assert spam.stuffed(df.limit(0)).count() == 0


def test_shapes_by_their_own_statistics(spark):
    rows = [(k, v) for k, v in (STUFFED | KEPT).items()]
    lines = shapes.lines(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text").persist()
    kinds = {r.shape: r.kind for r in shapes.shape_kinds(lines).collect()}
    assert set(kinds.values()) == {"link", "product", "tag", "keyword", "sentence"}
    assert len(kinds) == lines.select("shape").distinct().count()
    words = {r.id: r.n for r in lines.groupBy("id").sum("said").toDF("id", "n").collect()}
    assert words["refrain"] == 6 * 12 and words["numbers"] == 60 and "null" not in words and "blank" not in words
    assert {r.id for r in lines.where("links > 0").collect()} == {"links", "anchors", "papers"}


def test_long_lines_are_wrapped_and_none_is_lost(spark):
    text = "Heater repair\u2028pump\u00a0sale. " + " ".join(f"word{k}x" for k in range(40)) + "  \n" + "y" * 5000 + "\n\n" + "." * 5000
    rows = shapes.lines(spark.createDataFrame([("a", text), ("a", "one"), (None, "two")], "doc_id string, text string"), "doc_id", "text").collect()
    assert sorted(r.said for r in rows) == [1, 1, 2, 2, 4, 12, 12, 12] and {r.id for r in rows} == {"a"}
