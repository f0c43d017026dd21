import random
import re

from tidemark.llm import rules
from tidemark.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, measure string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    under = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(under)


def texts():
    random.seed(9)
    out = [None, "", " \n\t", "a", "\n\n\n", "x\ny\nx\nx", "é " * 30, "🙂 b " * 8]
    for _ in range(80):
        line = " ".join(random.choice("abcd") * random.choice([1, 3]) for _ in range(random.choice([3, 8, 12])))
        other = " ".join(random.choice(["#", "w1", "w2", "<b>", "\x0b", "\r"]) for _ in range(random.choice([0, 5, 40])))
        out.append("\n".join(random.choice([line, other, ""]) for _ in range(random.choice([1, 2, 6]))))
    return out


def test_counts(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, None if i % 5 else "en", "s" if i % 2 else None, "clash") for i, t in enumerate(rows)] + [(0, rows[0], "en", None, None)], SCHEMA)
    got = {r.doc_id: r for r in rules.judged(docs).collect()}
    assert len(got) == len(rows) and "measure" in next(iter(got.values())).asDict()
    for i, t in enumerate(rows):
        r = got[i]
        assert (r.rule_n_words, r.rule_word_chars, r.rule_n_symbols, r.rule_n_dup_lines, r.rule_n_repeat_words) == brute(t), repr(t)
        assert r.rule_base_failed == (r.rule_n_words < 20 or 100 * r.rule_n_repeat_words > 30 * r.rule_n_words)
        assert not (r.rule_base_failed and r.rule_kept)


def test_thresholds_follow_the_group(spark):
    random.seed(2)

    def text(n, length, symbols=0):
        return " ".join("".join(random.choices("abcdefgh", k=length)) + "#" * (random.random() < symbols) for _ in range(n))

    rows = [(i, text(60, 4), "en", "plain", None) for i in range(300)] + [(1000 + i, text(60, 12, 0.5), "xx", "marked", None) for i in range(300)]
    rows += [(5000, text(60, 12, 0.9), "en", "plain", None), (5001, text(60, 12, 0.5), "xx", "marked", None), (5002, text(60, 4), "en", "rare", None)]
    got = {r.doc_id: r for r in rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5000].rule_broken == "word_length,symbols" and not got[5000].rule_kept
    assert got[5001].rule_kept and got[5002].rule_kept
    assert sum(r.rule_kept for r in got.values()) > 0.9 * len(rows)


def quantile(values, part):
    """The bucket that the quantile falls in."""
    edge = sorted(values)[-(-len(values) * part // 1000) - 1] if values else None
    width = 1 << max(edge.bit_length() - rules.BITS, 0)
    return edge // width * width, edge // width * width + width - 1


def test_limits_are_quantiles_drawn_to_wider_ones(spark):
    """Against plain Python, and different between groups in every measure."""
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [r for r in rules.measured(docs.select("doc_id", "lang", "source", "text")).collect() if r.rule_n_words]
    got = {(r.rule_lang, r.rule_source): r for r in rules.limits(rules.measured(docs.select("doc_id", "lang", "source", "text"))).collect()}
    value = {
        "word_length": lambda r: r.rule_word_chars * 100 // r.rule_n_words,
        "symbols": lambda r: r.rule_n_symbols * 1000 // r.rule_n_words,
        "dup_lines": lambda r: r.rule_n_dup_lines * 1000 // r.rule_n_lines,
        "repeats": lambda r: r.rule_n_repeat_words * 1000 // r.rule_n_words,
    }
    for x in rules.LIMITS:
        for side, part in x.sides():
            end = lambda rs: quantile([value[x.name](r) for r in rs], part)[side == "high"]  # noqa: B023, E731
            total = end(rows)
            for (lang, source), r in got.items():
                in_lang = [q for q in rows if q.rule_lang == lang]
                own = [q for q in in_lang if q.rule_source == source]
                wide = (end(in_lang) * len(in_lang) + total * rules.PRIOR) // (len(in_lang) + rules.PRIOR)
                assert r[f"rule_{side}_{x.name}"] == (end(own) * len(own) + wide * rules.PRIOR) // (len(own) + rules.PRIOR)
            assert len({r[f"rule_{side}_{x.name}"] for r in got.values()}) > 3, (x.name, side)


def test_equal_texts_break_no_limit(spark):
    docs = spark.createDataFrame([(i, "some # word or other " * 3 + " ".join(map(str, range(30))), "en", "s", None) for i in range(50)], SCHEMA)
    assert {r.rule_broken for r in rules.judged(docs).collect()} == {""}


def test_clashing_names_and_long_texts(spark):
    names = ["RULE_LANG", "rule_source", "rule_words", "rule_l", "rule_s", "rule_row", "rule_text", "rule_kept", "rule_high_symbols", "rule.kept"]
    docs = spark.createDataFrame([(7, "w x " * 100_000, "en", *["own"] * len(names)), (8, None, None, *[None] * len(names))], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    out = rules.judged(docs, source_col="rule_l")
    assert out.columns == ["doc_id", "lang", *[n for n in names if n != "rule_kept"], *[f"rule_{c}" for c in (*rules.COUNTS, "base_failed", "broken", "kept")]]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[7]["rule_l"] == "own" and rows[7].rule_n_words == 200_000 and rows[7].rule_base_failed
    assert rows[8].rule_n_words == 0 and not rows[8].rule_kept


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 37 + 1), "en", "s", None) for i in range(200)], SCHEMA)
    rows = rules.measured(docs)
    key = ["rule_lang", "rule_source"]
    whole = rules.sketches(rows, key)
    parts = rules.sketches(rows.filter("rule_row.doc_id % 2 = 0"), key).unionByName(rules.sketches(rows.filter("rule_row.doc_id % 2 = 1"), key))
    assert whole.exceptAll(rules.merged(parts, key).select(*whole.columns)).count() == 0


def test_empty_table(spark):
    assert rules.judged(spark.createDataFrame([], SCHEMA)).collect() == []
