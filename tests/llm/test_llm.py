"""Operators for training text, against brute force and exact round trips."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

regex = pytest.importorskip("regex")

from pagelens.llm import mixing, overlap, proportions, sentences, tokenizer  # noqa: E402

DOC = "doc_id bigint, text string, source string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def automaton():
    return tokenizer.Automaton(tokenizer.read_vocabulary(tokenizer.default_vocabulary()))


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer.default_vocabulary())
    t.encode_special_tokens = True
    return t


SPLIT = regex.compile(tokenizer.PATTERN).findall


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="aabtehé  оа'1\n", max_size=80))
def test_encode_equals_the_library(automaton, library, text):
    ids = automaton.encode(text, SPLIT)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert automaton.decode(ids) == text


def test_small_vocabularies():
    """Merge by merge against the plain algorithm, over all words of a small alphabet."""
    r = random.Random(3)
    for _ in range(60):
        spelling, left, right, rank = [b"a", b"b", b"c"], [-1] * 3, [-1] * 3, [-1] * 3
        merges = []
        while len(merges) < r.randrange(1, 12):
            a, b = r.randrange(len(spelling)), r.randrange(len(spelling))
            if (a, b) in merges or spelling[a] + spelling[b] in spelling or len(spelling[a] + spelling[b]) > 6:
                if r.random() < 0.2:
                    break
                continue
            left.append(a), right.append(b), rank.append(len(merges)), spelling.append(spelling[a] + spelling[b])
            merges.append((a, b))
        np = pytest.importorskip("numpy")
        fa = tokenizer.Automaton({"spelling": spelling, "left": np.array(left), "right": np.array(right), "rank": np.array(rank)})
        for _ in range(80):
            word = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 12)))
            ids = [b"abc".index(x) for x in word]
            for k, (a, b) in enumerate(merges):
                new, i = [], 0
                while i < len(ids):
                    if ids[i : i + 2] == [a, b]:
                        new.append(3 + k)
                        i += 2
                    else:
                        new.append(ids[i])
                        i += 1
                ids = new
            assert list(fa.encode_bytes(word)) == ids


def test_encode_frame(spark):
    long = "слово <|endoftext|> " * 30_000
    df = spark.createDataFrame([(1, None, "a", "x", "y"), (2, "", "a", "x", "y"), (3, long, None, "x", None), (3, "а б", "b", None, None), (None, " ", "b", None, None)], DOC)
    out = tokenizer.encode(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = Counter((r["doc_id"], len(r["ids"])) for r in out.collect())
    assert got[(1, 0)] == got[(2, 0)] == 1 and sum(got.values()) == 5
    assert {r["text"] for r in tokenizer.decode(out).collect()} == {"", long, "а б", " "}
    assert tokenizer.encode(df.limit(0)).count() == 0
    counts = {r["key"]: r["n_tokens"] for r in tokenizer.count(df.where("doc_id < 3"), "doc_id").collect()}
    assert counts == {1: 0, 2: 0}


# ------------------------------------------------------------------------ sentences
CASES = {
    "А б. В г.": ["А б.", "В г."],
    "Заголовок 5\n\nТекст тут. Далі\nтекст.": ["Заголовок 5", "Текст тут.", "Далі\nтекст."],
    "На вул. Садова, буд. 5, жив проф. І. П. Коваль. Він спав.": ["На вул. Садова, буд. 5, жив проф. І. П. Коваль.", "Він спав."],
    "Сплачено 5 тис. крб. 14 коп. за хліб. Ціна 55 крб. Село спить.": ["Сплачено 5 тис. крб. 14 коп. за хліб.", "Ціна 55 крб.", "Село спить."],
    "Там були книги та ін. Потім ніч. Столи, терези і т. д. Сусід сів.": ["Там були книги та ін.", "Потім ніч.", "Столи, терези і т. д.", "Сусід сів."],
    "Дід сказав: «Село спить. Ніч іде!» Тоді пішов.": ["Дід сказав: «Село спить. Ніч іде!»", "Тоді пішов."],
    "«Хто там?» — спитав дід. „Я.“ Ми.": ["«Хто там?» — спитав дід.", "„Я.“", "Ми."],
    "Він (так. Саме так!), але пішов. Усе.": ["Він (так. Саме так!), але пішов.", "Усе."],
    "1) На столі. \n2. Під столом...\n\n 3. Ні": ["1) На столі.", "2. Під столом...", "3. Ні"],
    "Число 5! дорівнює 120. x = 3.5, а y. pH води 7.": ["Число 5! дорівнює 120.", "x = 3.5, а y.", "pH води 7."],
    "Кінець.Початок!Далі": ["Кінець.", "Початок!", "Далі"],
    "Квиток у... коморі. \tТак. ": ["Квиток у... коморі.", "Так."],
    "Der Schüler las z. B. Seite 1. Er kam am 3. Mai zurück zum 2. Mal.": ["Der Schüler las z. B. Seite 1.", "Er kam am 3. Mai zurück zum 2. Mal."],
    "« Le chat dort ! » dit-il. Il part ? Oui": ["« Le chat dort ! » dit-il.", "Il part ?", "Oui"],
    "¿El Sr. Gil? ¡Sí! No": ["¿El Sr. Gil?", "¡Sí!", "No"],
    "Ο κ. Νίκος ήρθε; Ναι. Όχι": ["Ο κ. Νίκος ήρθε;", "Ναι.", "Όχι"],
    "先生は「本を読んだ。地図を描いた！」と言った。生徒は帰った？": ["先生は「本を読んだ。地図を描いた！」と言った。", "生徒は帰った？"],
    "他说：“画了图。”学生回家……老师读书": ["他说：“画了图。”", "学生回家……", "老师读书"],
    "นักเรียนอ่านหน้า 12 ดัง ครูลืมสมุด": ["นักเรียนอ่านหน้า 12 ดัง", "ครูลืมสมุด"],
    "डॉ. राम ने पृ. 5 पढ़ा। सीता?": ["डॉ. राम ने पृ. 5 पढ़ा।", "सीता?"],
    "Աշակերտը կարդաց 5.5 էջ։ Նա գրեց։": ["Աշակերտը կարդաց 5.5 էջ։", "Նա գրեց։"],
    "د. نوران قرأ ص. 5 صباحا؟ نعم. لا": ["د. نوران قرأ ص. 5 صباحا؟", "نعم.", "لا"],
    "Зошит 🙂! Село. «Без кінця. Так": ["Зошит 🙂!", "Село.", "«Без кінця. Так"],
    "рядок | 1.5\nдва | 2.5\n\nТак.\r\n\r\nНі.\r\nОсь": ["рядок | 1.5\nдва | 2.5", "Так.", "Ні.", "Ось"],
    " a.  B c.": [" a.", " B c."],
    "   \n\t ": [], "": [], None: [],
}


def test_units(spark):
    texts = list(CASES)
    df = spark.createDataFrame([(i, t, "a", "k", None) for i, t in enumerate(texts)], DOC)
    got = {i: [] for i in range(len(texts))}
    for r in sorted(sentences.units(df).collect()):
        got[r["doc_id"]].append(texts[r["doc_id"]][r["sent_start"] : r["sent_end"]])
    assert {texts[i]: x for i, x in got.items()} == CASES
    whole = {(r["doc_id"], r["sentence"]) for r in sentences.sentences(df).collect()}
    assert whole == {(i, s) for i, x in got.items() for s in x}
    assert sentences.units(df.limit(0)).count() == 0


def test_units_of_deep_nests(spark):
    """Closed pairs of one kind, or of several, hold their own text only, however deep they nest."""
    whole = [f"А {o * n}б. В{c[0] * n} г." for o, c in sentences.PAIRS if o not in c for n in (2, 3, 4, 7)] + ["A (b (c (d. E) f) g) h.", "А (б «в [г (д. Е) є] ж» з) и.", "А " + "(" * 150 + "б. В" + ")" * 150 + " г."]
    open_end = "А (((((б. В) г. Ґ) д."
    df = spark.createDataFrame([(i, f"{x} I j. K l.") for i, x in enumerate(whole)] + [(-1, open_end)], "doc_id bigint, text string")
    got: dict[int, list] = {}
    for r in sorted(sentences.sentences(df).collect()):
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    assert got.pop(-1) == [open_end]
    assert got == {i: [x, "I j.", "K l."] for i, x in enumerate(whole)}


def test_units_without_bounds(spark):
    """No length of an address, a run of closing marks, an indent, a tag or a special token changes the units."""
    url = "https://a.ua/" + "b.c?d=" * 300
    texts = [[f"Див. {url}e тут.", "Далі."], ["Так" + "." + ")" * 70, "Ні."], [" " * 50 + "1. На столі.", "Кінець."], ["Так.", "<" + "t" * 60 + "> далі."], ["Так!", "[UNK] Далі."], ["Так [MASK] ні.", "[PAD] [PAD] так"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got: dict[int, list] = {}
    for r in sorted(sentences.sentences(df).collect()):
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    assert got == {0: texts[0], 1: texts[1], 2: ["1. На столі.", "Кінець."], 3: ["Так. <" + "t" * 60 + "> далі."], 4: texts[4], 5: ["Так [MASK] ні.", "[PAD] [PAD] так"]}
    assert sentences.units(spark.createDataFrame([(1, "。" + "」" * 60 + "次")], "doc_id bigint, text string")).count() >= 1


def test_units_cover(spark):
    """Everything but white space is in exactly one unit, for any text; long ones too."""
    r = random.Random(7)
    parts = ["А", "б", "c", " ", "\n", "\n\n", ".", "!", "?", "«", "»", "(", ")", '"', "“", "„", "。", "「", "」", "5", "ก", " ", "—", "…", "🙂", "​"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(400)] + ["Він пішов. " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found: dict[int, list] = {}
    for x in sorted(sentences.units(df).collect()):
        found.setdefault(x["doc_id"], []).append((x["sent_start"], x["sent_end"]))
    for i, t in enumerate(texts):
        end = 0
        for a, b in found.get(i, []):
            assert end <= a < b <= len(t) and not t[end:a].strip() and t[a:b] == t[a:b].strip()
            end = b
        assert not t[end:].strip()
    assert len(found[len(texts) - 1]) == 3000


# -------------------------------------------------------------------------- overlap
def test_image_key(spark):
    same = ["images/ab-1_p2.jpg", "ab-1_p2.JPEG", "x\\y\\AB-1_p2_light_aug001.png", "images/ab-1_p2_aug_mix_aug12.jpg", "ab-1_p2 (1).jpg", "ab-1_p2 - копія.jpg", "ab-1_p2_copy.jpg", "ab-1_p2_aug003.jpg"]
    df = spark.createDataFrame([(x,) for x in [*same, "ab-1_p1.jpg", "ab-1.jpg", None, ""]], "f string")
    keys = [r["k"] for r in df.select(overlap.image_key(F.col("f")).alias("k")).collect()]
    assert keys == ["ab-1_p2"] * len(same) + ["ab-1_p1", "ab-1", None, None]


def test_pipelines_of_augmentation(spark):
    """Copies of every pipeline pair by name alone; other words before the suffix stay."""
    names = ["u.jpg", "u_aug_light_aug001.jpg", "u_aug_rare_aug001.jpg", "x/u_aug_dense_aug002.PNG", "u_rare_aug1.jpg", "u_dense_aug12.jpeg", "u_diary_aug001.jpg"]
    df = spark.createDataFrame([(k, "train" if k else "test", x, None, None, None, None) for k, x in enumerate(names)], REGIONS)
    assert {tuple(x) for x in overlap.found(df).collect()} == {(0, k) for k in range(1, 6)}


REGIONS = "record_id bigint, split string, file_name string, source string, regions array<struct<text:string,type:string>>, image string, class string"


def _words(texts):
    joined = " ".join(regex.sub(r"(?s)~~.*?~~(?:\{(.*?)\})?", lambda m: m[1] or "", t) for t in texts)
    return Counter(overlap._normal(joined))


def test_found_against_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"слово{i}" for i in range(40)]
    pages = []
    for k in range(240):
        if pages and r.random() < 0.6:
            words = " ".join(r.choice(pages)[4]).split()
            for _ in range(r.choice([0, 1, 2, 8])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            r.shuffle(words)
        else:
            words = [r.choice(vocabulary) for _ in range(r.randrange(5, 30))]
        cut = r.randrange(1, len(words))
        pages.append((k, r.choice(["train", "silver", "val", "test", "private", "other"]), f"a/{r.randrange(150)}.jpg", None, [" ".join(words[:cut]), " ".join(words[cut:])]))
    pages += [(900, "train", None, "x", None), (901, "val", "", "x", []), (902, None, "a/1.jpg", "x", [None, "а" * 80])]
    df = spark.createDataFrame([(*p[:4], None if p[4] is None else [(t, "printed") for t in p[4]], "z", "z") for p in pages], REGIONS)
    got = {tuple(x) for x in overlap.found(df).collect()}
    want = set()
    for a in pages:
        for b in pages:
            if a[1] in overlap.TRAIN and b[1] in overlap.EVAL:
                names = a[2] and a[2] == b[2]
                long = all(p[4] and sum(len(t or "") for t in p[4]) >= 60 for p in (a, b))
                x, y = (_words(p[4]) if long else Counter() for p in (a, b))
                alike = long and 5 * (x & y).total() >= 4 * max(x.total(), y.total())
                if names or alike:
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want and len(want) > 50
    assert overlap.found(df.limit(0)).count() == 0
    assert sum(x["pairs"] for x in overlap.report(df).collect()) == len(want)


def test_normal_text():
    a, b = "Скажи ~~старе~~{нове} «Слово», п'ять!", "скажи нове слово п’ять"
    assert overlap._normal(regex.sub(r"(?s)~~.*?~~(?:\{(.*?)\})?", lambda m: m[1] or "", a)) == overlap._normal(b)
    assert overlap._normal("COCНА йод") == overlap._normal("сосна иод")
    assert overlap._numbered("а б а а") == "а а#1 а#2 б" and overlap._numbered("!!") is None


def test_hot_keys_are_cut(spark):
    """Every pair once, and no cell of a hot key with more rows than two parts hold."""
    left = spark.range(4000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("x"))
    right = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("y"))
    loads = left.groupBy("k").agg(F.count("*").alias("n")).join(right.groupBy("k").agg(F.count("*").alias("m")), "k")
    want = {tuple(r) for r in left.join(right, "k").collect()}
    got = overlap.spread(left, right, "k", loads, 4900, side=100)
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    text = got._jdf.queryExecution().analyzed().toString()
    assert "_a" in text and "Generate" in text  # cut into cells
    per = got.where("k = -1").groupBy(F.pmod(F.xxhash64("x"), F.lit(36)).alias("a"), F.pmod(F.xxhash64("y"), F.lit(6)).alias("b")).agg(F.count_distinct("x").alias("n"), F.count_distinct("y").alias("m")).collect()
    assert len(per) == 36 * 6 and max(r["n"] for r in per) < 200 and max(r["m"] for r in per) < 200
    assert "_a" not in overlap.spread(left, right, "k", loads, 4900, side=10_000).select("*")._jdf.queryExecution().analyzed().toString()


def test_recall_at_the_limit(spark):
    """Pairs that share exactly 80 % of the longer one's words, and ones just below it."""
    r = random.Random(5)
    pages = []
    for k in range(500):
        words = [f"слово{r.randrange(10**6)}" for _ in range(50)]
        pages.append((2 * k, "train", None, None, [(" ".join(words), "printed")], None, None))
        changed = [f"інше{r.randrange(10**6)}" for _ in range(10 if k < 400 else 11)] + words[10 if k < 400 else 11 :]
        r.shuffle(changed)
        pages.append((2 * k + 1, "val", None, None, [(" ".join(changed), "printed")], None, None))
    got = {tuple(x) for x in overlap.found(spark.createDataFrame(pages, REGIONS)).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(400)} and len(got) >= 0.985 * 400  # 0.9965 expected at a similarity of 2/3


def test_pairs_by_chance_are_dropped_where_they_meet(spark):
    """Texts of common words share buckets by chance, the more the more pages there are; only a few of them become candidates."""
    r = random.Random(17)
    vocabulary = [f"слово{i}" for i in range(150)]
    pages = [(k, "train" if k % 2 else "val", None, None, [(" ".join(r.sample(vocabulary, 40)), "printed")], None, None) for k in range(800)]
    for k in range(40):  # 36 of 40 words
        words = pages[2 * k][4][0][0].split()[:36] + [f"інше{r.randrange(10**6)}" for _ in range(4)]
        pages.append((1000 + k, "silver", None, None, [(" ".join(words), "printed")], None, None))
    df = spark.createDataFrame(pages, REGIONS)
    assert overlap.candidates(overlap.prepare(df)[1]).count() < 120
    assert {tuple(x) for x in overlap.found(df).collect()} >= {(2 * k, 1000 + k) for k in range(40)}


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_sketches_of_pairs_at_the_limit(spark, similarity):
    """Their sketches differ by less than is allowed, whatever bucket they meet in."""
    r = random.Random(3)
    rows, n = [], 50
    for k in range(1000):
        words = [f"слово{r.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: round(n * similarity)] + [f"інше{r.randrange(10**6)}" for _ in range(n - round(n * similarity))]))]
    own = overlap.buckets(spark.createDataFrame(rows, "id bigint, words string"), 40, 5).dropDuplicates(["id"]).collect()
    at = {x["id"]: x for x in own}
    differ = [sum(((at[2 * k][s] ^ at[2 * k + 1][s]) & 2**64 - 1).bit_count() for s in ("s0", "s1")) for k in range(1000)]
    assert max(differ) <= overlap.apart(similarity, overlap.BITS) and {x["size"] for x in own} == {n}


def test_copies_and_links(spark):
    """Copies of one text on both sides: all pairs of rows, one class of them."""
    text = " ".join(f"слово{i}" for i in range(30))
    rows = [(i, "train" if i % 2 else "val", None, None, [(text, "printed")], None, None) for i in range(60)]
    rows += [(100, "silver", None, None, [(text + " ще", "printed")], None, None), (101, "test", None, None, [("коротко", "printed")], None, None)]
    df = spark.createDataFrame(rows, REGIONS)
    assert overlap.found(df).count() == 30 * 31
    got = {r["record_id"]: (r["class_id"], r["links"]) for r in overlap.links(df).collect()}
    assert got == {i: (0, 2) for i in range(60)} | {100: (100, 1)}
    assert overlap.links(df.limit(0)).count() == 0


# ---------------------------------------------------------------------- proportions
@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda c: st.lists(st.lists(st.floats(0, 30), min_size=c, max_size=c), min_size=1, max_size=6)))
def test_controlled_rounding(table):
    out = proportions.controlled_rounding(table)
    near = lambda x, y: y - 1 - 1e-5 < x < y + 1 + 1e-5
    assert all(near(x, q) for row, qs in zip(out, table) for x, q in zip(row, qs))
    assert all(near(sum(row), sum(qs)) for row, qs in zip(out, table))
    assert all(near(sum(x[j] for x in out), sum(q[j] for q in table)) for j in range(len(table[0])))
    assert abs(sum(map(sum, out)) - sum(map(sum, table))) < 1 and all(x >= 0 for row in out for x in row)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 40), st.integers(0, 9), st.lists(st.integers(0, 30), min_size=3, max_size=3)), min_size=1, max_size=6))
def test_quotas(targets):
    cells, met = proportions.quotas(targets)
    for (target, low, n), row, ok in zip(targets, cells, met):
        assert all(0 <= q <= m for q, m in zip(row, n))
        assert ok == (sum(n) >= target - 1e-9 and sum(n) >= low)
        assert sum(row) >= min(sum(n), max(target, low)) - 1e-6
    total, drawn = sum(t for t, _, _ in targets), sum(map(sum, cells))
    spare = any(t > 1e-6 and sum(row) < sum(n) for (t, _, n), row in zip(targets, cells))
    assert drawn >= total - 1e-6 or not spare  # what one lacks, the others give


def test_shares_where_one_is_lacking():
    cells, met = proportions.quotas([(50, 0, [10, 0]), (30, 0, [300, 300]), (20, 0, [500, 0]), (0.2, 5, [40, 0])])
    assert met == [False, True, True, True] and [sum(r) for r in cells] == [10, 52, 35, 5]  # 3 to 2, made whole upwards


def test_many_targets():
    """Thousands of categories: the rounding stays quick."""
    import time

    r, began = random.Random(3), time.perf_counter()
    table = [[r.random() * 5 for _ in range(6)] for _ in range(3000)]
    out = proportions.controlled_rounding(table)
    assert time.perf_counter() - began < 30
    assert all(abs(sum(a) - sum(b)) < 1 for a, b in zip(out, table))


def test_sample(spark):
    rows = [(i, "train" if i % 2 else "val", f"f{i}", [" School", "dictation", None][i % 3], [("printed", "x")] * (i % 4) or None) for i in range(300)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(20)]  # delivered again
    pages = spark.createDataFrame([(*r[:4], [(t, k) for k, t in r[4]] if r[4] else None) for r in rows], "record_id bigint, split string, file_name string, source string, regions array<struct<text:string,type:string>>")
    targets = spark.createDataFrame([("a", "source", "school", 0.5, 1, 0.2), ("a", "source", "Dictation ", 0.5, 1, 0.2), ("b", "type", "printed", 1.0, None, 0.5), ("b", "type", "table", 0.1, 2, 0.1), ("c", "source", "museum", None, 3, None)], "plan_id string, field string, category string, target_share double, min_rows int, sample_fraction double")
    rep = {(r["plan_id"], r["category"]): r for r in proportions.report(pages, targets).collect()}
    assert rep[("a", "school")]["pool"] == 300 and rep[("a", "school")]["members"] == 100 and rep[("a", "school")]["drawn"] == 30
    assert sorted(k for k, r in rep.items() if not r["met"]) == [("b", "table"), ("c", "museum")]
    drawn = proportions.sample(pages, targets).collect()
    assert Counter((r["plan_id"], r["category"]) for r in drawn) == {("a", "school"): 30, ("a", "dictation"): 30, ("b", "printed"): 230}  # 225 and what tables lack
    assert len({(r["plan_id"], r["record_id"], r["region_idx"]) for r in drawn}) == len(drawn) and all(r["record_id"] < 1000 for r in drawn)
    assert Counter(r["stratum"] for r in drawn if r["plan_id"] == "a" and r["category"] == "school") == {"train": 15, "val": 15}
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, proportions.sample(pages.repartition(7), targets).collect()))
    assert proportions.sample(pages.limit(0), targets).count() == 0
    assert proportions.sample(pages, targets.limit(0)).count() == 0


# --------------------------------------------------------------------------- mixing
@settings(max_examples=100, deadline=None)
@given(st.floats(0.001, 7.5), st.integers(1, 8))
def test_thresholds(rate, cap):
    edges = mixing.thresholds(rate, cap)
    assert len(edges) == cap and edges == sorted(edges) and all(0 <= x <= 1 for x in edges)
    assert abs(sum(1 - x for x in edges) - min(rate, cap)) < 1e-6


@pytest.mark.parametrize(("rate", "cap"), [(700, 1000), (745, 900), (800, 1000), (2000, 2100), (5000, 8000), (999.5, 1000)])
def test_thresholds_of_great_rates(rate, cap):
    edges = mixing.thresholds(rate, cap)
    assert edges == sorted(edges) and abs(sum(1 - x for x in edges) - rate) < 1e-3


def test_mix(spark):
    docs = spark.createDataFrame([(i, "слово " * 5, [" Archive", "SCHOOL", None][i % 3], None, None) for i in range(3000)] + [(9000, None, "school", None, None), (9001, "", "void", None, None)], DOC)
    targets = spark.createDataFrame([("m", "archive", 0.5, 4, 0.5), ("m", "school", 0.5, 1, 0.5), ("n", "archive", 1.0, 2, 1.0), ("n", "void", 0.1, 9, 0.1), ("n", "none", None, None, None)], "mix_id string, source string, weight double, max_repeats int, budget_share double")
    assert {tuple(r) for r in mixing.found(docs, targets).collect()} == {("n", "archive"), ("n", "void")}
    rep = {(r["mix_id"], r["source"]): r for r in mixing.report(docs, targets).collect()}
    assert rep[("n", "archive")]["reached"] == 2 * rep[("n", "archive")]["tokens"] and rep[("n", "archive")]["most"] == 2
    for key in (("m", "archive"), ("m", "school")):
        assert abs(rep[key]["reached"] / rep[key]["target"] - 1) < 0.1
    assert rep[("m", "school")]["most"] == 1 and rep[("n", "none")]["reached"] == 0
    out = mixing.mix(docs, targets).collect()
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    assert max(r["copy"] for r in out if r["mix_id"] == "n") == 2
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.found(docs.limit(0), targets).count() == 0
