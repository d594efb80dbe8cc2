import base64
import os
import random

import pytest

from sievework.llm import leakage, mojibake, tokens

RANKS = f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary here")
WORDS = "the run of a ledger was refused because its scope had changed since we last measured every module twice".split()


@needs_vocabulary
def test_ids(spark):
    import tiktoken

    ranks = tokens.read_ranks(RANKS)
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    random.seed(1)
    texts = [None, "", " ", "a" * 5000, "<|endoftext|>", "it's  5 €\r\n\t x  ", "日本語 текст 🚀 e\u0301", "\x00\u2028\u00a0y"]
    texts += ["".join(random.choice("ab '\n1é  .x\u3000") for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, "")], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text", ranks).collect()}
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text", ranks), "doc_id", tokens.pieces(spark, ranks))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_corpus(df.where("false"), "doc_id", "text", ranks).count() == 0


def runs(document, item, least):
    a, b = leakage.words_of(document), leakage.words_of(item)
    grams = {tuple(b[i : i + least]) for i in range(len(b) - least + 1)}
    return any(tuple(a[i : i + least]) in grams for i in range(len(a) - least + 1))


def test_leaks_against_brute_force(spark):
    random.seed(2)
    items = [" ".join(random.choice(WORDS) + str(random.randrange(9)) for _ in range(40)) for _ in range(12)]
    docs = [None, "", "short"]
    for _ in range(150):
        words = [random.choice(WORDS) for _ in range(random.randrange(60))]
        if random.random() < 0.6:
            item = random.choice(items).split()
            n = random.choice([11, 12, 13, 14, 30])
            i = random.randrange(len(item) - n + 1)
            passage = item[i : i + n]
            if random.random() < 0.2:
                passage[n // 2] = "edited"
            k = random.randrange(len(words) + 1)
            words[k:k] = [w.upper() + random.choice(["", ",", "_"]) for w in passage]
        docs.append(" ".join(words))
    docs += docs[-40:]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    it = spark.createDataFrame(list(enumerate([*items, items[0], None])), "item_id long, text string")
    out = leakage.leaked(df, it, doc_id="doc_id", item_id="item_id", doc_text="text", item_text="text").where("longest_run >= 13")
    want = {(i, j) for i, t in enumerate(docs) if t for j, x in enumerate([*items, items[0]]) if runs(t, x, 13)}
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want and want
    assert leakage.leaked(df, it.where("false"), doc_id="doc_id", item_id="item_id", doc_text="text", item_text="text").count() == 0


def test_recall_of_edited_copies(spark):
    """Copies with every tenth word changed, dropped or added, and cut to a half: at least nine in ten are scored, no stranger is."""
    random.seed(3)
    vocabulary = [f"{w}{i}" for w in WORDS for i in range(20)]
    items = [[random.choice(vocabulary) for _ in range(45)] for _ in range(20)]
    docs, truth = [], set()
    for k in range(400):
        filler = [random.choice(vocabulary) for _ in range(80)]
        if k % 2:
            j = random.randrange(len(items))
            begin = random.choice([0, 22]) if k % 4 == 1 else 0
            copy = []
            for w in items[j][begin : begin + 23 if k % 4 == 1 else 45]:
                edit = random.random()
                copy += [] if edit < 0.03 else [random.choice(vocabulary)] if edit < 0.07 else [w, random.choice(vocabulary)] if edit < 0.1 else [w]
            filler[40:40] = copy
            truth.add((k, j))
        docs.append((k, " ".join(filler)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    out = leakage.leaked(df, it, doc_id="doc_id", item_id="item_id", doc_text="text", item_text="text", n=5, window=5, shared=3).where("coverage >= 0.3").collect()
    found = {(r.doc_id, r.item_id) for r in out}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.01 * len(found)
    print("recall", len(found & truth) / len(truth))


def test_alignment():
    item = WORDS
    assert leakage.align(item, item)[:2] == (2 * len(item), len(item))
    edited = [*item[:7], "x", *item[8:]]
    score, longest, begin, end = leakage.align(["q", "r", *edited], item)
    assert longest == len(item) - 8 and (begin, end) == (10, 2 + len(item)) and score > longest * 2
    assert leakage.align([], item) == (0, 0, 0, 0)


CLEAN = ["naïve counting doesn’t explain it", "der Lauf wurde gelöscht und später geprüft", "модуль не разобран", "次の比較までに設定を確認", "Próg został obniżony", "un café déjà vu — « été »"]
FINE = ["Â, Ã, Ä and Æ sort after Z", "λ(x) ∈ Ω, √50 ≥ π", "│ é │", "├── a", "£ · ¥ · § 3", "🚀 👩‍💻 ✅", "e\u0301te\u0301", "ÇÃO NÃO", "£5 × 3 ≠ £6 – no", "中文没有变化"]


@pytest.mark.parametrize("written,read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "gb18030"), ("latin-1", "mac_roman"), ("cp1251", "latin-1"), ("iso8859_2", "latin-1")])
def test_undo(written, read):
    for text in CLEAN:
        try:
            spoiled = text.encode(written).decode(read)
        except UnicodeError:
            continue
        assert mojibake.undo(spoiled, written, read) == text


def test_garbled(spark):
    rows = []
    for k in range(12):
        rows += [(len(rows) + i, f"{t} {k}") for i, t in enumerate([*CLEAN, *FINE])]
    fine = len(rows)
    spoiled = [CLEAN[0].encode().decode("cp1252"), CLEAN[1].encode("latin-1").decode("mac_roman"), CLEAN[2].encode("cp1251").decode("latin-1"), CLEAN[4].encode().decode("cp437"), CLEAN[5].encode().decode("latin-1").encode().decode("latin-1"), "it\ufffds gone", "w\x00i\x00d\x00e\x00r\x00"]
    rows += [(fine + i, t) for i, t in enumerate(spoiled)] + [(9000, None), (9001, ""), (9002, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = mojibake.garbled(df, "doc_id", "text")
    assert {r.id for r in found.collect()} == set(range(fine, fine + len(spoiled)))
    back = {r.doc_id: (r.restored, r.complete) for r in mojibake.restore(df, found, "doc_id", "text").collect()}
    assert back[fine] == (CLEAN[0], True) and back[fine + 1] == (CLEAN[1], True) and back[fine + 2] == (CLEAN[2], True)
    assert back[fine + 5] == ("it\ufffds gone", False) and back[fine + 6][0] == "wider"


def test_garbled_on_empty(spark):
    assert mojibake.garbled(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_run_mappings_outside_the_table_are_learned_from_twins(spark):
    """A damage no encoding explains: the letters between ASCII ones are replaced by signs that nobody writes together."""
    damage = {"ö": "αж", "é": "βш"}  # letters of two alphabets in one run
    spoil = lambda t: "".join(damage.get(c, c) for c in t)
    words = ["gelöscht", "grölen", "höher", "später", "fröhlich", "böig", "möglich", "öffnet", "café", "idée", "année", "musée", "lycée", "allée", "née"]
    rows = [(k * 100 + i, w) for k in range(20) for i, w in enumerate(words)]
    taught = [(9000 + i, spoil(w)) for i, w in enumerate(words) if spoil(w) != w]
    df = spark.createDataFrame(rows + taught, "doc_id long, text string")
    found = mojibake.garbled(df, "doc_id", "text")
    assert {r.id for r in found.collect()} == {i for i, _ in taught} and {r.source for r in found.collect()} == {"twins"}
    assert {r.doc_id: r.restored for r in mojibake.restore(df, found, "doc_id", "text").collect()} == {9000 + i: w for i, w in enumerate(words) if spoil(w) != w}


def test_one_sequence_is_enough_under_a_taught_reading(spark):
    garble = lambda t: t.encode().decode("cp1252")
    words = ["gelöscht", "größer", "höher", "naïve", "später"]
    rows = [(k * 10 + i, w) for k in range(12) for i, w in enumerate(words)] + [(500 + i, garble(w)) for i, w in enumerate(words)]
    df = spark.createDataFrame([*rows, (900, garble("¬merge")), (901, "Â and Ã sort after Z"), (902, "d'accord «Ã»")], "doc_id long, text string")
    found = {r.id: r.source for r in mojibake.garbled(df, "doc_id", "text").collect()}
    assert set(found) == {500, 501, 502, 503, 504, 900} and set(found.values()) == {"twins"}


@needs_vocabulary
def test_repeated_and_null_ids(spark):
    ranks = tokens.read_ranks(RANKS)
    df = spark.createDataFrame([(1, "same words, same ids", 7), (1, "same words, same ids", 8), (2, "x﷐y ﷐", 9), (None, "nobody", 1)], "doc_id long, text string, ids int").repartition(3)
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, "doc_id", "text", ranks).collect()}
    back = tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text", ranks), "doc_id", tokens.pieces(spark, ranks))
    assert {r.doc_id: r.text for r in back.collect()} == {1: "same words, same ids", 2: "x﷐y ﷐", None: "nobody"} and len(got) == 3


def test_copies_of_a_file_are_parsed_once_and_judged_alike(spark):
    from sievework.llm.parsing import parse_files

    rows = [(i, "Python" if i % 2 else "Go", f"a{i}.py", "x = (" if i % 3 else "x = 1", i) for i in range(40)] + [(99, None, None, None, 1)]
    df = spark.createDataFrame(rows, "file_id long, lang string, path string, text string, valid int")
    got = {r.file_id: r.valid for r in parse_files(df, ["file_id"], text="text", language="lang", path="path").collect()}
    assert got == {99: None, **{i: i % 2 == 1 and i % 3 == 0 for i in range(40)}}


def test_a_sure_transformation_is_undone_in_the_whole_document():
    garble = lambda t: t.encode().decode("cp850")
    fixes = {mojibake.normal(garble("später—")): ("utf-8", "cp850", 1)}
    assert mojibake._mend(garble("¬merge später— fiza™") + " café", fixes) == ("¬merge später— fiza™ café", False)
    assert mojibake._mend("gelˆscht sp‰ter", {"gelˆscht": ("latin-1", "mac_roman", 1)}) == ("gelöscht sp‰ter", True)
