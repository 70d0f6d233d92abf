from pyspark.sql import functions as F

from gablework.operators import extract, quality
from gablework.operators.normalize import normalize
from gablework.streaming import volumes

PAGE = """<html><body><div class="re__breadcrumb"><ul><li><a>Bán</a></li><li><a>Hà Nội</a></li><li><a>Dự án X</a></li>
<li><a>Nhà riêng</a></li></ul></div><h1> Nhà  đẹp </h1>
<div class="re__pr-short-info"><div class="re__pr-short-info-item"><span class="title">Khoảng giá</span><span class="value">2 tỷ</span></div>
<div class="re__pr-short-info-item"><span class="title">Diện tích</span><span class="value">100 m²</span></div>
<div class="re__pr-short-info-item"><span class="title">Mã tin</span><span class="value">123</span></div></div>
<span class="re__pr-specs-content-item-title">Số phòng ngủ</span><span class="re__pr-specs-content-item-value">3 phòng</span>
<span class="re__pr-specs-content-item-title">Pháp lý</span><span class="re__pr-specs-content-item-value">Sổ đỏ</span>
<span class="re__pr-specs-content-item-title">Số tầng</span><span class="re__pr-specs-content-item-value"></span>
<div class="re__section-body">%s</div></body></html>""" % "".join(f"<p>câu {i}</p>" for i in range(30))


def test_detail_records(spark):
    url = "https://h/ban-nha-rieng-duong-a-tai-phuong1-quan2-ha-noi/pr1"
    pages = spark.createDataFrame([(url, PAGE)], "url string, html string")
    records = extract.detail_records(pages, F.lit("2024-01-01T00:00:00+00:00"))
    row = records.first()
    assert (row.listing_id, row.title, row.price_text, row.area_text) == ("123", "Nhà đẹp", "2 tỷ", "100 m²")
    assert (row.bedroom_text, row.legal_text, row.floor_text) == ("3 phòng", "Sổ đỏ", None)
    assert (row.property_type, row.province_slug, row.district_slug, row.ward_slug) == ("house", "ha-noi", "quan2", "phuong1")
    assert row.project_hint == "Dự án X" and row.verified == 1
    assert row.description == " ".join(f"câu {i}" for i in range(18))
    assert len(records.columns) == 25
    normal = normalize(records, F.lit("now")).first()
    assert (normal.price_vnd, normal.area_m2, normal.bedroom_count) == (2e9, 100.0, 3)
    assert normal.is_model_candidate and normal.feature_coverage_score == 6


def test_crawl_bookkeeping(spark):
    configs = spark.createDataFrame([(1, 3, None), (1, 3, 3), (1, 2, 9)], "start_page int, max_pages int, next_page int")
    pages = extract.page_frontier(configs).collect()
    assert sorted(r.page for r in pages) == [1, 2, 3, 3]
    counted = spark.createDataFrame([(1, 5), (2, 4), (3, 0), (4, 2)], "page int, links int")
    assert sorted(r.page for r in extract.before_first_empty_page(counted, "page", "links").collect()) == [1, 2]
    full = counted.where("links > 0")
    assert extract.before_first_empty_page(full, "page", "links").count() == 3
    links = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "link string, pos int")
    seen = spark.createDataFrame([("a",)], "link string")
    assert sorted(r.link for r in extract.unseen(links, seen).collect()) == ["b", "c"]
    assert extract.with_remaining_budget(links, ["pos"], 12, 10).count() == 2
    assert extract.with_remaining_budget(links, ["pos"], 5, 9).count() == 0


def test_requests(spark):
    df = spark.createDataFrame([("90", "x", "house"), ("-1", None, "castle")], "area_m2 string, bedroom_count string, property_type string")
    typed = quality.typed_request(df, {"area_m2": "double", "bedroom_count": "int"})
    typed = typed.withColumns({c: F.lit(None).cast("int") for c in ["bathroom_count", "floor_count"]}).withColumns(
        {c: F.lit(None).cast("double") for c in ["front_width_m", "road_width_m"]}
    )
    rows = typed.withColumns({"codes": quality.request_codes(), "errors": quality.request_errors()}).collect()
    assert rows[0].type_errors == ["1002:bedroom_count"] and rows[0].codes == [] and rows[0].errors == []
    assert rows[1].codes == ["1003:area_m2", "1004:property_type"] and rows[1].errors == ["area_m2"]


def test_streaming_volume_and_unseen(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:50:00"), ("a", "2024-01-01 01:10:00"), ("z", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "link string, t string").select("link", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))

    def run(result, name):
        query = (
            result.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.table(name).collect()

    hours = run(volumes.hourly_volume(stream), "hours")
    assert sorted((r.hour.hour, r.rows) for r in hours) == [(0, 2), (1, 1)]
    assert sorted(r.link for r in run(volumes.unseen(stream, "link", "ts"), "links")) == ["a", "b", "z"]
