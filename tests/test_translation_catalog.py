"""Translation round trip, catalog/cap golden values, shard plans."""

from pyspark.sql import functions as F

from promptlake.operators import translation as X
from promptlake.operators.catalog import cap_rule_a, cap_rule_b
from promptlake.sources.files import fractional_plan, shard_manifest

TEMPLATES = [
    ("d", "s", "n1", "{{ a }} and {% if b %}{b}{% endif %}\n||| {{c}}", "x ||| y"),
    ("d", None, "n2 - with dash ", " ".join("{{ f%d }}" % i for i in range(12)) + " ||| z", None),
]


def _templates(spark):
    return spark.createDataFrame(TEMPLATES, "dataset string, subset string, name string, jinja string, answer_choices string")


def test_mask_then_restore_is_identity(spark):
    m = X.mask_templates(_templates(spark))
    rows = {r.key: r for r in m.collect()}
    assert rows["d - s - n1"].masked == "{e1} and {e2}{e3}{e4}\n||| {e5}"
    assert rows["d - s - n1"].entities == ["{{ a }}", "{% if b %}", "{b}", "{% endif %}", "{{c}}"]
    tr = m.select(F.col("key").alias("template_name"), F.lit("de").alias("lang"), F.col("masked").alias("translated"))
    back = {r.key: r.jinja for r in X.restore_translations(tr, m, prefix="").collect()}
    assert back == {f"{d} - {s or 'None'} - {n}": j for d, s, n, j, _ in TEMPLATES}


def test_repair_rules(spark):
    df = spark.createDataFrame([("50٪ of {E 1} | | | {E 10}",), ("a |x| b\nc",), ("{Mixed Case}",)], "t string")
    got = [r.r for r in df.select(X.repair("t").alias("r")).collect()]
    assert got == ["50% of {e1} ||| {e10}", "a ||| b\nc", "{mixed case}"]


def test_restore_keeps_unknown_and_e10(spark):
    df = spark.createDataFrame([("{e1}-{e10}-{e99}", ["A", "B", "C", "D", "E", "F", "G", "H", "I", "J"])], "t string, e array<string>")
    assert df.select(X.restore("t", "e").alias("r")).first().r == "A-J-{e99}"


def test_key_parse_and_trailing_space_lookup(spark):
    m = X.mask_templates(_templates(spark))
    d, s, n = X.parse_key(F.lit("d - None - n2 - with dash "))
    r = spark.range(1).select(d.alias("d"), s.alias("s"), n.alias("n")).first()
    assert (r.d, r.s, r.n) == ("d", None, "n2 - with dash ")
    tr = spark.createDataFrame([("d - None - n2 - with dash", "fr", "[fr] {e1}")], "template_name string, lang string, translated string")
    out = X.restore_translations(tr, m).first()
    assert out.key == "d - None - n2 - with dash " and out.jinja == X.PREFIX + "[fr] {{ f0 }}"


def test_add_translated_skips_existing_and_numbers(spark):
    existing = _templates(spark).unionByName(
        spark.createDataFrame([("d", "s", "n1-translate-de", "x ||| y", None)], "dataset string, subset string, name string, jinja string, answer_choices string")
    )
    restored = spark.createDataFrame(
        [("d - s - n1", "de", "j", None), ("d - s - n1", "fr", "j", "a ||| b"), ("d - None - n2 - with dash ", "de", "j", None)],
        "key string, lang string, jinja string, answer_choices string",
    )
    out = {(r.dataset, r.subset, r.name): r for r in X.add_translated(existing, restored).collect()}
    assert set(out) == {("d", "s", "n1-translate-fr"), ("d", None, "n2 - with dash -translate-de")}
    assert out[("d", "s", "n1-translate-fr")].id == "00000000-0000-0000-0000-000000000000"
    assert out[("d", "s", "n1-translate-fr")].reference == "Translated version of n1 in fr"


def test_cap_rules_golden(spark):
    df = spark.createDataFrame([(3_600_000, 9), (288_065, 4), (500_000, 1), (500_001, 7), (None, 3)], "n long, t long")
    r = df.select(
        cap_rule_a(F.col("n"), F.col("t"), F.col("n").isNotNull()).alias("a"), cap_rule_b(F.col("n"), F.col("t")).alias("b")
    ).collect()
    assert [x.a for x in r] == [55_555, 288_065, 500_000, 71_428, 500_000]
    assert [x.b for x in r[:4]] == [55_555, 125_000, 500_000, 71_428]


def test_shard_plan_golden(spark):
    shards = spark.createDataFrame([("en", 11264, 32), ("ru", 4096, 32), ("zu", 8, 1)], "lang string, train long, validation long")
    fr = spark.createDataFrame([("en", 0.2), ("ru", 0.5)], "lang string, fraction double")
    m = shard_manifest(shards)
    plan = {r.lang: r.k for r in fractional_plan(m, fr).select("lang", "k").distinct().collect()}
    assert plan == {"en": 2253, "ru": 2049, "zu": 8}
    f = m.where((F.col("lang") == "en") & (F.col("idx") == 7) & (F.col("split") == "validation")).first().file
    assert f == "c4-en-validation.tfrecord-00007-of-00032.json.gz"
    assert fractional_plan(m, fr, ["zu"]).count() == 8
