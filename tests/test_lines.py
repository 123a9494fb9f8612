"""What a line's own text says of it, found by searches that end early, against the rules as they are declared."""

import random

from pyspark.sql import functions as F

from colloquy import functions
from colloquy.dialect import SPARK
from colloquy.plans import analytics, procedures

WORDS = [
    "Amara.org", "the", "The,", "(the)", "[Musik]", "(music)", "*", "* laughs *", "....", "…", "--", "a--b", "a.", "b. ", "b.\u0085c", "c! ", " ", "Ⅷ", "x²", "İ", "시청해", "ДА", "שלום", "ไทย", "×", "ǅ", "ªº", "́", "é.", "www.x", "copyright", "SDI Media", "Tack för att du har tittat", "thanks for watching",
    "Subtitled by", "undertexter av", "översatt av", "　", "\t", "\r", "_", "'tis", "漢字", "ελ", "हि", "عر", "one", "two", "\v", "𝒳", "👍",
]
LINES = "id long, recording_id long, utterance_index long, text string, start_time double, end_time double, speaker string, mean_p double, low_frac double, voice_match double, neighbour_cosine double"


def lines(spark, n=3000):
    r = random.Random(3)
    texts = [None, "", " "]
    for _ in range(n):
        some = r.sample(WORDS, r.choice((1, 2, 3, 4, 8, 30)))
        texts.append(r.choice((" ", " ", "", "\t", "\n")).join(r.choice(some) for _ in range(r.choice((0, 1, 2, 3, 4, 6, 9, 14, 25, 40)))))
    return spark.createDataFrame([(i, i % 50, i, t, 0.0, float(i % 20), "v", None, None, None, None) for i, t in enumerate(texts)], LINES)


def test_lines_are_judged_as_the_rules_say(spark):
    t = lines(spark)
    t.createOrReplaceTempView("odd_lines")
    held = " OR ".join([*(f"contains(low, {SPARK.text(m)})" for m in (*analytics.MARKERS, *analytics.PHRASES)), "(contains(low, 'copyright') AND contains(low, 'sdi media'))"])
    want = spark.sql(f"SELECT id, text, lower(text) AS low, {SPARK.trimmed('lower(text)')} AS ws, {SPARK.canonical('text')} AS norm, NOT {SPARK.matches(analytics.bare(SPARK), '[\\p{L}\\p{N}]')} AS empty FROM odd_lines").withColumn("n", F.size("ws"))
    want = want.withColumns({"r": functions.runs(F.col("ws")), "credit": F.expr(analytics.is_credit(SPARK, "low", "n")), "embedded": F.expr(f"n > {analytics.CREDIT_WORDS} AND ({held})")})
    dots = SPARK.sub("replace(low, '…', '...')", "[ \t\n\r]+", "")
    want = want.withColumns({
        "filler": F.expr(f"size(array_distinct(ws)) BETWEEN 1 AND 3 AND {SPARK.matches(dots, '[.]{4}')}"), "soft": (F.col("r.run") >= 3) | ((F.col("n") >= 10) & (F.size(F.array_distinct("ws")) <= 0.5 * F.col("n"))),
        "loop": (F.col("n") >= functions.LOOP_WORDS) & (F.col("r.run") >= functions.LOOP_RUN) & (F.col("r.covered") >= functions.LOOP_SHARE * F.col("n")),
    })
    for step in analytics.script_steps(SPARK)[: procedures.LETTERS]:
        want = want.selectExpr("*", *[step] if " AS " in step and "," not in step else _parts(step))
    names = ["id", "norm", "n", *analytics.SCRIPTS]
    kinds = ["empty", "credit", "embedded", "filler", "loop", "soft"]
    rows = lambda df: {r.id: tuple(r) for r in df.select(*names, *(F.coalesce(c, F.lit(False)).alias(c) for c in kinds)).collect()}
    want, got = rows(want), rows(procedures._of_line(t))
    assert got == want
    assert all(sum(r[len(names) + k] for r in want.values()) > 20 for k in range(len(kinds)))


def _parts(step):
    """Columns of a select list, which has commas within parentheses as well."""
    out, depth = [""], 0
    for c in step:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def test_what_marks_a_credit_has_a_root():
    assert all(any(r in m for r in procedures.ROOTS) for m in (*analytics.MARKERS, *analytics.PHRASES, "copyright", "www."))


def test_a_loop_is_told_from_no_loop(spark):
    """Where words come three times but make no loop, it is no loop, not unknown: the softer reason counts."""
    t = spark.createDataFrame([(1, 1, 0, "no no no we talked about the plan for next week", 0.0, 9.0, "v", None, None, None, None), (2, 2, 0, "ready to work " * 6, 0.0, 9.0, "v", None, None, None, None)], LINES)
    assert sorted(map(tuple, procedures._of_line(t).select("id", "loop", "soft").collect())) == [(1, False, True), (2, True, True)]


def test_java_compiles_what_judges_lines(spark, sf_dir):
    """Java interprets methods of more than 8,000 bytes, for each line."""
    plan = procedures._of_line(lines(spark, 10))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(plan)
    assert made.size() and max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())) < 8000


def test_no_pattern_is_run_word_by_word(spark):
    plan = procedures._of_line(lines(spark, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(regexp_replace" not in plan
