"""Record files of every version and flag set, read back or written by hand; the formats told apart."""

import itertools
import struct

import pyarrow as pa
import pytest

from spotlattice.sources import formats, records

FLAG_SETS = [c for n in range(5) for c in itertools.combinations(records.FLAGS, n)]
ROWS = [(1, 2, 3, 5, 7, 8, 0.5, 0.25, 1.5, 2.5, 10.0, 100.0, 3.25, 4.75, 0.125, 1.25, 1.5, 20.5, 0.0625), (0, 0, 4, 4, -1, 0, -0.5, 1e-300, 0.0, 0.0, -1.0, 1e30, 1e-30, 0.1, 0.0, 1.0, 1.0, 0.0, 0.0)]
COLUMNS = "id int, category int, frame int, end_frame int, orig_x int, orig_y int, orig_value float, error double, noise float, mean_intensity float, background float, intensity float, x float, y float, z float, sx float, sy float, precision float, x_sd float"


@pytest.mark.parametrize("kind", ["Text", "Binary"])
def test_every_flag_set(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, COLUMNS).coalesce(1)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    stored = {r["frame"]: r for r in df.collect()}
    for k, (flags, deviations) in enumerate(itertools.product(FLAG_SETS, (False, True))):
        if kind == "Text" and k % 3:
            continue
        path, layout = str(tmp_path / f"{kind}{k}"), records.layout_for(df, kind, flags, deviations)
        (records.write_text if kind == "Text" else records.write_binary)(df, path, layout)
        assert [x["layout"] for x in records.describe(spark, path)] == [layout]
        got = (records.read_text if kind == "Text" else records.read_binary)(spark, path).collect()
        assert len(got) == 2
        for r in got:
            own = stored[r["frame"]]
            for c in names:
                absent = {"end_frame": own["frame"], "precision": None}.get(c, 0) if c in records.FLAGS and c not in flags else None if c == "x_sd" and not deviations else own[c]
                assert r[c] == absent, (c, flags, deviations)


def test_files_of_different_layouts_together(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS).coalesce(1)
    for k, flags in enumerate(((), ("id",), ("id", "end_frame", "precision"))):
        records.write_text(df, str(tmp_path / "all" / str(k)), records.layout_for(df, "Text", flags, k == 2))
    got = records.read_text(spark, str(tmp_path / "all" / "*")).collect()
    assert len(got) == 6 and sorted(r["id"] for r in got) == [0, 0, 0, 0, 1, 1]


def put(path, text):
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)
    return str(path)


HEAD = "#Localisation Results File\n#FileVersion {tag}\n"


def test_versions_by_hand(spark, tmp_path):
    v3 = put(tmp_path / "v3", HEAD.format(tag="Text.D0.E6.V3") + "#Id\tFrame\torigX\torigY\torigValue\tError\tNoise (photon)\tBackground\tIntensity\tX (px)\tY (px)\tZ\tS (px)\tPrecision (nm)\n7\t1\t2\t3\t4\t5\t6\t10\t20\t1.5\t2.5\t0\t1.1\t30.5\n7\t2\t2\t3\t4\t5\t6\t10\t20\t1.5\t2.5\t0\t1.1\t30.5*\n")
    a, b = sorted(records.read_text(spark, v3).collect(), key=lambda r: r["frame"])
    assert (a["id"], a["sx"], a["sy"], a["precision"], b["precision"], a["mean_intensity"], a["end_frame"]) == (7, pytest.approx(1.1), pytest.approx(1.1), 30.5, None, 0, 1)
    assert records.describe(spark, v3)[0]["units"]["X"] == "px"
    v2 = put(tmp_path / "v2", HEAD.format(tag="Text.D1.E0.V2") + "#Frame\torigX\torigY\torigValue\tError\tNoise\t...\n3\t1\t2\t4\t5\t6\t" + "\t".join(f"{k}\t0.{k}" for k in range(1, 8)) + "\n")
    r = records.read_text(spark, v2, bias=0.5).first()
    assert (r["background"], r["intensity"], r["angle"], r["x"], r["y"], r["sx"], r["sy"], r["x_sd"], r["z"]) == (0.5, 2, 3, 4, 5, 6, 7, pytest.approx(0.4), 0)
    v1 = put(tmp_path / "v1", HEAD.format(tag="Text") + "#Frame\torigX\torigY\torigValue\tError\tNoise\tSignal\tBackground\tAmplitude\n3\t1\t2\t4\t5\t6\t99\t1\t2\t3\t4\t5\t6\t7\n")
    r = records.read_text(spark, v1).first()
    assert (r["intensity"], r["background"], r["x"]) == (99, 1, 4)
    body = struct.pack(">iiifdf7f", 3, 1, 2, 4.0, 5.0, 6.0, 1, 2, 3, 4, 5, 6, 7)
    b1 = put(tmp_path / "b1", (HEAD.format(tag="Binary") + "#Binary Format = iiifdffffffff\n#END_HEADER\n").encode() + body * 2 + b"torn")
    got = records.read_binary(spark, b1).collect()
    assert len(got) == 2 and got[0]["intensity"] == pytest.approx(2 * 2 * 3.14159265 * 42, rel=1e-6)


def test_bad_lines(spark, tmp_path):
    line = "1\t2\t3\t4\t5\t6\t7\t8\t9\t10\t11\t12\n"
    head = HEAD.format(tag="Text.D0.E0.V4") + "#Frame\torigX\torigY\torigValue\tError\tNoise\tMean\tBackground\tIntensity\tX\tY\tZ\n"
    assert records.read_text(spark, put(tmp_path / "few", head + line * 5 + "oops\n" * 9)).count() == 5
    with pytest.raises(ValueError):
        records.read_text(spark, put(tmp_path / "many", head + line * 5 + "oops\n" * 10)).count()
    with pytest.raises(ValueError):
        records.read_text(spark, put(tmp_path / "none", line))


def test_sniffing(spark, tmp_path):
    kinds = {
        "text_records": HEAD.format(tag="Text.D0.E0.V4"), "binary_records": HEAD.format(tag="Binary.D0.E0.V4"), "results_table": "#Id\tPeak\torigX\torigY\torigValue\tError\tNoise\n",
        "nstorm": "Channel Name\tX\tY\n", "malk": "1.0 2.0 3 4.0\n1 2 3 4\n", "rapidstorm": "# <localizations x=1>\n1 2 3 4 5\n", "delimited": "a,b\n1,2\n", "unknown": "# nothing\n",
    }
    for kind, text in kinds.items():
        assert formats.sniff(spark, put(tmp_path / kind, text)) == kind


def test_header_lines_go_by_place(spark, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    for k in range(3):
        put(folder / f"{k}.txt", f"# note\n1\t2.5\n9\t{k}\n1\t2.5\n2\t{k}\n")  # a row like the header line of its own file
    got = formats.delimited(spark, str(folder), {"frame": 0, "x": 1}, header=2).collect()
    assert sorted((r.frame, r.x) for r in got) == [(1, 2.5)] * 3 + [(2, 0.0), (2, 1.0), (2, 2.0)]


def test_rapidstorm_widths_and_residue(spark, tmp_path):
    path = put(tmp_path / "r", "# <localizations />\n10 20 3 400 4 9 0.5 1.25\n10 20 3 400\n")
    r = formats.rapidstorm(spark, path).collect()
    assert len(r) == 1 and (r[0].sx, r[0].sy, r[0].error, r[0].frame) == (2000.0, 3000.0, 1.25, 3)


def test_registry(spark):
    formats.register(spark.range(3), "some_rows")
    assert "some_rows" in formats.registered(spark) and formats.resolve(spark, "some_rows").count() == 3
    formats.unregister(spark, "some_rows")
    assert "some_rows" not in formats.registered(spark)


def test_binary_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """A file of many ranges is many tasks' rows, and each record is read once; ranges smaller than a header too."""
    df = spark.range(5000).selectExpr("CAST(id AS INT) AS id", "CAST(id AS INT) AS frame", "1.0F AS intensity", "CAST(id AS FLOAT) AS x", "2.0F AS y").coalesce(1)
    path = str(tmp_path / "with a blank")
    records.write_binary(df, "file://" + str(tmp_path / "one"), records.layout_for(df, "Binary"))
    (tmp_path / "one").rename(path)
    for size in (100, 1000, 1 << 20):
        monkeypatch.setattr(records, "RANGE", size)
        seen = records._ranged(0.0)
        file = next((tmp_path / "with a blank").glob("*.bin"))
        length = file.stat().st_size
        parts = [pa.RecordBatch.from_pydict({"path": [f"file:{file}"], "length": [length], "number": [k]}) for k in range((length - 1) // size + 1)]
        read = [list(seen([p])) for p in parts]
        assert [i for out in read for b in out for i in b.column(0).to_pylist()] == list(range(5000))
        assert max(sum(b.num_rows for b in out) for out in read) <= size // 50 + 1
    monkeypatch.undo()
    assert sorted(r.x for r in records.read_binary(spark, path).collect()) == list(range(5000))
