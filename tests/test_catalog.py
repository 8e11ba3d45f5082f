"""Functions called from SQL give what the column functions give."""

from pyspark.sql import functions as F

from tessera.functions import catalog
from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.operators import rollup, temporal

ROWS = [(1, "Ａ «كَتَبَ» الوَلَدُ، x-y (z)!", "3abc", "red widget"), (2, "وبالكتاب  [a] \"q\" 'b'", " -.5 m", "widget red"), (3, "", "x", "red"), (4, None, None, None), (5, "ARE you—here…", "7.", "")]


def test_sql_functions_equal_column_functions(spark):
    catalog.register(spark)
    spark.createDataFrame(ROWS, "id int, s string, n string, w string").createOrReplaceTempView("catalog_rows")
    pairs = {
        "fold_loose(s)": T.fold_loose(F.col("s")), "fold_words(s)": T.fold_words(F.col("s")), "fold_compare(nfc_text(s))": T.fold_compare(F.col("s")), "normalize_search(s)": T.normalize_search(F.col("s")), "compare_verify(nfc_text(s))": T.compare_verify(F.col("s")),
        "strip_marks(s)": T.strip_marks(F.col("s")), "to_arabic_digits(n)": T.to_arabic_digits(F.col("n")), "to_western_digits(n)": T.to_western_digits(F.col("n")), "short_name(s)": T.short_name(F.col("s")), "bare_word(s)": T.bare_word(F.col("s")),
        "number_prefix(n)": N.number_prefix(F.col("n")), "mcq_match(s, n)": N.mcq_match(F.col("s"), F.col("n")), "slot_compare(w, 'widget red')": N.slot_compare(F.col("w"), F.lit("widget red")), "tier_for(id / 6D)": rollup.tier_for(F.col("id") / 6),
        "mastery_step(0.5D, 1D)": temporal.step(F.lit(0.5), F.lit(1.0)), "seal_text(split(s, ' '))": T.seal(F.split("s", " ")), "marker_phrases(s, array('you', 'كتب'))": T.marker_hits(F.col("s"), ["you", "كتب"], {}), "first_phrase(s, array(struct('x' AS phrase, 'A' AS value), struct('a' AS phrase, 'B' AS value)))": T.first_enum(F.col("s"), {"x": "A", "a": "B"}),
        "pick_id(n, array(3L, 7L))": T.pick_id(F.col("n"), F.expr("array(3L, 7L)")), "pick_id(CAST(id AS STRING), array(1L, 4L))": T.pick_id(F.col("id").cast("string"), F.expr("array(1L, 4L)")),
        "stage_vowelled(s)": T.stage_vowelled("s"), "words_with_places(s)": T.words_with_places("s"),
    }
    rows = spark.table("catalog_rows")
    for sql, column in pairs.items():
        assert spark.sql(f"SELECT id, {sql} AS x FROM catalog_rows ORDER BY id").collect() == rows.select("id", column.alias("x")).orderBy("id").collect(), sql
    assert abs(spark.sql("SELECT mastery_fold(array(1D, 0D)) AS x").first().x - (0.3 + 0.15 * 0.7) * 0.85) < 1e-12
    got = spark.sql("SELECT b.kind FROM parse_message('a {{beat}}', false) b").collect()
    assert [r.kind for r in got] == ["para", "beat"]
    assert spark.sql("SELECT size(chat_directives('{{beat}} {{check_in}}')) AS n").first().n == 2
