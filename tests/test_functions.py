import datetime

from pyspark.sql import functions as F

from panelspark.functions import grid, text, values


def one(spark, *cols, **data):
    names = list(data)
    df = spark.createDataFrame([tuple(data[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(data[n], str) or data[n] is None else 'double' if isinstance(data[n], float) else 'long'}" for n in names)) if names else spark.range(1)
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_cell_keys_round_trip_and_bounds(spark):
    key = grid.encode_cell(F.lit(32767), F.lit(65535), F.lit(2**32 - 1))
    ix, iy, local = grid.decode_cell(key)
    assert one(spark, ix, iy, local) == (32767, 65535, 2**32 - 1)
    assert one(spark, grid.encode_cell(F.lit(32768), F.lit(0), F.lit(0))) == (None,)


def test_grid_spec(spark):
    g = grid.GridSpec(10.0, 0.0, -1.0, 1.0, 5000, 3000)
    assert g.tiles(spark).count() == 3 * 2
    assert g.pad(2).n_rows == 5004 and g.pad(2).lat0 == 12.0
    assert g.zoom_to(2.0).n_rows == 2500
    assert g.tile_for(4096.0) == 4096
    assert one(spark, grid.coordinate_index(F.lit(10.4), 10.0, -1.0, 5), grid.coordinate_index(F.lit(-99.0), 10.0, -1.0, 5)) == (0, 4)


def test_distances(spark):
    d = one(spark, grid.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0]
    assert abs(d - 3.14159265 * 6371.0088) < 1e-3
    lat, lon = one(spark, *grid.sinusoidal_inverse(F.lit(1111950.5), F.lit(1111950.5)))
    assert abs(lat - 10) < 1e-3 and abs(lon - 10.154) < 1e-2


def test_pack_unpack(spark):
    v = F.col("v")
    assert one(spark, values.pack(v), values.pack(F.lit(3.5)), v=2.5) == (2, 4)
    assert one(spark, values.pack(F.lit(float("nan"))), values.pack(F.lit(1e300))) == (65535, 65535)
    assert one(spark, values.unpack(F.lit(65535)), values.unpack(F.lit(10), 0.5, 1.0)) == (None, 6.0)


def test_classes(spark):
    cuts = [(0.55, "LO"), (0.7, "ME")]
    c = lambda x: values.classify(F.lit(x).cast("double"), cuts, "HI")
    assert one(spark, c(0.55), c(0.1), c(0.7), c(None)) == ("ME", "LO", "HI", None)
    assert one(spark, values.undummy({"a": F.lit(True), "b": F.lit(True)}), values.normalized_difference(F.lit(0.0), F.lit(0.0))) == ("b", None)


def test_text(spark):
    s = F.col("s")
    year, day = text.file_date(s)
    assert one(spark, year, day, s="x.A2000055.h00") == (2000, 55)
    assert one(spark, year, day, s="year 1987") == (1987, 0)
    assert one(spark, year, day, s="none") == (0, 0)
    assert one(spark, *text.tile_file(s).values(), s="P.V.A200005.h00v10.1.hdf") == (None,) * 4
    assert one(spark, text.bounded_year(s, 1992, 2030), s="v1980 of 2001, 2005") == (2001,)
    assert one(spark, text.strip_host(s), s="me@host.org:/data/x") == ("/data/x",)
    assert one(spark, text.written_number(s), s="(2,5)") == (-2.5,)
    assert one(spark, text.written_number(s), s="1.234,5") == (1234.5,)
    assert one(spark, text.written_number(s), s="NA") == (None,)
    for status, want in (("FAILED: x", "failed"), ("FAILED", "other"), ("", "pending"), (None, "pending"), ("DOWNLOADING", "downloading"), ("downloading", "other")):
        assert one(spark, text.status_category(s), s=status) == (want,)
    assert one(spark, text.source_type(s, [("dmsp", "DMSP"), ("viirs", "VIIRS")]), s="a/VIIRS/b") == ("VIIRS",)
    assert one(spark, text.latex_escape(s), s="a_b%") == ("a\\_b\\%",)


def test_segments(spark):
    got = one(spark, text.segments(F.col("s")), s="(2001) opened mine  (2005) shut")[0]
    assert [tuple(x) for x in got] == [(1, "2001", "opened mine"), (2, "2005", "shut")]
    assert [tuple(x) for x in one(spark, text.segments(F.col("s")), s="no dates")[0]] == [(1, None, "no dates")]


def test_dates(spark):
    assert one(spark, text.day_of_year(F.lit(2000), F.lit(60)), text.year_end(F.lit(1999))) == (datetime.date(2000, 2, 29), datetime.date(1999, 12, 31))
    assert one(spark, text.fiscal_year(F.lit(51)), text.fiscal_year(F.lit(50))) == (1951, 2050)
    assert one(spark, text.duration_seconds(F.col("s")), s="1-02:03:04") == (93784,)
    assert one(spark, text.duration_seconds(F.col("s")), s="05:06") == (306,)
    assert one(spark, text.duration_seconds(F.col("s")), s="soon") == (None,)
    assert one(spark, text.duration_text(F.lit(93784))) == ("1-02:03:04",)
    assert one(spark, text.duration_text(F.lit(59))) == ("0-00:00:59",)
