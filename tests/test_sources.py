import json

from attestor.operators.chunks import section_chunks
from attestor.plans.review import review
from attestor.sources import spl
from attestor.sources import tables as st

XML = """<document xmlns="urn:hl7-org:v3"><setId root="s-1"/><versionNumber value="7"/><effectiveTime value="20260618120000"/>
<subject><manufacturedProduct><manufacturedProduct><name>Sample  Drug</name><asEntityWithGeneric><genericMedicine><name>Samplide</name></genericMedicine></asEntityWithGeneric></manufacturedProduct></manufacturedProduct></subject>
<component><structuredBody>
<component><section><code code="48780-1"/><title>Data</title><text>no</text></section></component>
<component><section><code code="99999-9"/><title>Odd</title><text>no</text></section></component>
<component><section><code code="34066-1"/><title>WARNING: RISK OF TUMORS</title><text><paragraph>Tumors   occurred<sup>a</sup> at 10<sup>9</sup>/L.</paragraph></text></section></component>
<component><section><code code="34067-9"/><title>1 INDICATIONS</title><text>Drug is indicated:<list><item><caption>•</caption>adults with <content>type 2</content> diabetes<list><item>and diet</item></list></item><item><caption>o</caption><paragraph>12 years and older</paragraph></item></list></text>
<component><section><code code="42229-5"/><title>1.1 Limits</title><text><table><caption>Table 1</caption><thead><tr><th>x</th><th>n</th></tr></thead><tbody><tr><td>row<br/>one</td><td>-2.4</td></tr><tr><td/><td/></tr></tbody></table></text></section></component></section></component>
</structuredBody></component></document>"""


def files(spark):
    return spark.createDataFrame([("drug", bytearray(XML.encode()))], "label_key string, content binary")


def test_label_fields_and_sections(spark):
    parsed = spl.labels(files(spark))
    r = parsed.first()
    assert (r.set_id, r.version, r.effective_time, r.products, r.generic, r.skipped_codes) == ("s-1", 7, "20260618", ["SAMPLE DRUG"], "samplide", ["99999-9"])
    rows = spl.sections(parsed).orderBy("section_index").collect()
    assert [x.path for x in rows] == ["WARNING: RISK OF TUMORS", "1 INDICATIONS", "1 INDICATIONS > 1.1 Limits"]
    assert rows[0].text == "Tumors occurred at 10^9/L."
    assert rows[1].text == "Drug is indicated:\n\n- adults with type 2 diabetes\n  - and diet\n  - 12 years and older"
    assert rows[2].text == "Table 1\nx | n\nrow one | -2.4" and rows[2].top_code == "34067-9"
    assert rows[1].sec_start == len(rows[0].text) + 2
    scalars = spl.scalar_fields(files(spark)).first()
    assert (scalars.set_id, scalars.version, scalars.effective_time) == ("s-1", 7, "20260618")


def test_folder_of_labels(spark, tmp_path):
    (tmp_path / "one.xml").write_text(XML)
    assert [r.label_key for r in spl.read_labels(spark, str(tmp_path)).collect()] == ["one"]


def test_cache_damage_upsert_and_manifest(spark, tmp_path):
    key = "a" * 64
    (tmp_path / "aa").mkdir()
    (tmp_path / "aa" / f"{key}.json").write_text(json.dumps({"key": key, "model_key": "m", "prompt_version": "v", "schema": "Rewrite", "response": {"rewrite": "text"}, "usage": {"prompt_tokens": 1, "completion_tokens": 2}}, indent=1))
    (tmp_path / "aa" / "bad.json").write_text("{ not json")
    cache = st.answer_cache(spark, str(tmp_path))
    assert [r.key for r in cache.collect()] == [key]
    assert st.answers(cache, "Rewrite").first().answer.rewrite == "text"
    new = cache.withColumn("model_key", st.F.lit("n"))
    assert [r.model_key for r in st.put_answers(cache, new).collect()] == ["n"]
    assert st.manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"drug": {"set_id": "s", "version": 6, "xml_sha256": "x"}}))
    pinned = st.manifest(spark, str(tmp_path / "m.json"))
    assert [r.state for r in st.drift(spl.labels(files(spark)), pinned).collect()] == ["newer"]


def test_reports(spark, tmp_path):
    st.write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"), "Title")
    text = "".join(p.read_text() for p in sorted((tmp_path / "r/md").glob("part*")))
    assert text.startswith("# Title") and "| 1 | n/a |" in text


def test_review_of_copies(spark):
    sections = spl.sections(spl.labels(files(spark))).drop("set_id")
    chunks = section_chunks(sections).select("chunk_id", "label_key", st.F.col("path").alias("section_path"), "top_code", "context", "text")
    copies = spark.createDataFrame([(1, "Sample Drug is for adults with type 2 diabetes. It works in 99% of people."), (2, "Nothing named here at all.")], "doc_id long, text string")
    meta = spark.createDataFrame([("drug", ["SAMPLE DRUG"], "samplide")], "label string, names array<string>, generic string")
    done = review(copies, chunks, meta)
    status = {(r.doc_id, r.n): (r.verdict, r.status) for r in done.reviews.collect()}
    assert status[(1, 2)] == ("unsupported", "unsupported")
    events = [(r.doc_id, r.id, r.event) for r in done.events.orderBy("doc_id", "id").collect()]
    assert events == [(1, 0, "start"), (1, 1, "claims"), (1, 2, "claim"), (1, 3, "claim"), (1, 4, "document"), (1, 5, "done"), (2, 0, "error")]


def test_listing_without_a_hit_is_reported(spark):
    from attestor.sources import tables as st

    listing = spark.createDataFrame([("a", "BRAND MAKER INC", "s1", 1), ("b", "OTHER CORP", "s2", 9), ("b", "ANOTHER CORP", "s3", 9)], "key string, title string, set_id string, spl_version int")
    specs = spark.createDataFrame([("a", "brand", "maker"), ("b", "other", "maker"), ("c", "x", "maker")], "key string, query string, manufacturer string")
    assert {r.key: r.message for r in st.without_hit(listing, specs).collect()} == {"b": "b: no label from maker: [ANOTHER CORP, OTHER CORP]", "c": "c: no label from maker: []"}


def test_a_labels_drug_names_it(spark):
    from pyspark.sql import functions as F

    from attestor.operators.service import label_name

    rows = [("k", ["A", "A PEN"], "Drug"), ("k", ["A", "A PEN"], ""), ("k", [], None)]
    df = spark.createDataFrame(rows, "key string, products array<string>, drug string")
    assert [r[0] for r in df.select(label_name(F.col("products"), F.col("key"), F.col("drug"))).collect()] == ["Drug", "A", "K"]
