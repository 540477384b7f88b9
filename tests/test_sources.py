"""Crystal files and other inputs: parsing, expansion, round trips, streaming."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from porelake.operators import inference as I
from porelake.sources import cif, files

TWO = """# made for a test
data_one
_cell_length_a 10.0(1)
_cell_length_b 10.0
_cell_length_c 10.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_symmetry_space_group_name_H-M 'P -1'
loop_
_symmetry_equiv_pos_as_xyz
 'x, y, z'
 '-x, -y, -z'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Zn1 Zn2+ 0 0 0
C1 C 0.25(2) 0.1 0.1
;note
_atom_site_fract_x inside a text
;
data_two
_cell_length_a 5
_cell_length_b 6
_cell_length_c 7
_cell_angle_alpha 80
_cell_angle_beta 85
_cell_angle_gamma 95
loop_
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
O 0.1 0.2 0.3"""


def test_reads_a_folder(spark, tmp_path):
    (tmp_path / "0000[Co]1, x.cif").write_text(TWO)
    (tmp_path / "bad.cif").write_text("data_x\n_cell_length_a ?\n")
    (tmp_path / "other.txt").write_text("no")
    got = {(r.name, r.block_idx): r for r in cif.read_structures(spark, str(tmp_path)).collect()}
    one, two = got["0000[Co]1, x", 0], got["0000[Co]1, x", 1]
    assert one.n_atoms == 3 and one.a == 10 and one.sg_hm == "P -1" and [a.element for a in one.atoms] == ["Zn", "C", "C"]
    assert two.n_blocks == 2 and two.atoms[0].fz == 0.3 and two.volume > 0
    assert got["bad", 0].error and got["bad", 0].n_atoms == 0
    labels = {r["name"]: r["labels"] for r in cif.precheck(cif.read_structures(spark, str(tmp_path))).collect()}
    assert labels == {"0000[Co]1, x": {"0000[Co]1, x_1": "has metal and carbon", "0000[Co]1, x_2": "missing metal and carbon"}}
    only = cif.read_structures(spark, str(tmp_path), names=["bad.cif"]).collect()
    assert [r.name for r in only] == ["bad"]


def test_empty_folder(spark, tmp_path):
    assert cif.read_structures(spark, str(tmp_path)).count() == 0


def test_operations_and_expansion():
    w, t = cif.parse_operation("-y+1/2, x-y, z+0.25")
    assert w.tolist() == [[0, -1, 0], [1, -1, 0], [0, 0, 1]] and t.tolist() == [0.5, 0, 0.25]
    with pytest.raises(ValueError):
        cif.parse_operation("import os, y, z")
    ops = [f"{a}x,{b}y,{c}z" for a in ("", "-") for b in ("", "-") for c in ("", "-")]
    block = cif.parse(TWO)[0]
    block.loops[0] = (block.loops[0][0], [[o] for o in ops])
    assert len(cif.structure(block)["sites"]) == 9


def test_round_trip_of_the_writer():
    text = cif.write_text("back", [5, 6, 7, 80, 85, 95], [("O1", "O", 0.1, 0.2, 0.3), (None, "Zn", 0.5, 0.5, 0.5)])
    s = cif.structure(cif.parse(text)[0])
    assert [x[1] for x in s["sites"]] == ["O", "Zn"] and s["size"] == [5, 6, 7, 80, 85, 95] and s["sites"][0][2].tolist() == [0.1, 0.2, 0.3]


def test_repair():
    assert cif.repair("#x\n_a 1").split("\n")[1] == "data_struc" and cif.repair("#x\ndata_y") == "#x\ndata_y"


def test_isotherm(spark):
    text = "data_i\n_units_loading mmol/g\nloop_\n_adsorp_pressure\n_adsorp_amount\n0.1 1.5\n0.2 2.5(1)\n"
    rows = spark.createDataFrame([("a", text), ("b", text + text)], "path string, content string")
    got = {r.path: r for r in cif.read_isotherms(rows).collect()}
    assert got["a"].uptake == ["1.5", "2.5(1)"] and got["a"].uptake_value == [1.5, 2.5] and got["a"].loading_unit == "mmol/g" and got["b"].error


def test_records(spark, tmp_path):
    (tmp_path / "cr.json").write_text(json.dumps({"unit": {"PLD": "A"}, "ASR": {"e1": {"PLD": 3.5}}, "FSR": {}, "Ion": {}}))
    (tmp_path / "ncr.json").write_text(json.dumps({"e2": {"PLD": 4.5}}))
    records = files.read_records(spark, str(tmp_path / "cr.json"), str(tmp_path / "ncr.json"))
    value = F.expr("variant_get(record, '$.PLD', 'double')").alias("v")
    assert files.lookup_record(records, "CR-ASR", "e1").select(value).first().v == 3.5
    assert files.lookup_record(records, "NCR", "e2").select(value).first().v == 4.5
    assert files.lookup_record(records, "CR-FSR", "e1").count() == 0
    with pytest.raises(ValueError):
        files.lookup_record(records, "XX", "e1")


def test_archive_and_reports(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("CR/a.cif", "x")
        z.writestr("readme", "y")
    rows = spark.createDataFrame([("z", bytearray(data.getvalue()))], "path string, content binary")
    assert [r.path for r in files.archive_members(rows).collect()] == ["CR/a.cif"]
    text = spark.createDataFrame([("out.res 5.1 4.2 5.0\n", "@ x ASA_A^2: 10.5 ASA_m^2/cm^3: 2 ASA_m^2/g: 3 NASA_A^2: 1 NASA_m^2/cm^3: 0 NASA_m^2/g: 0", "f 1 channels identified of dimensionality 3\n")], "pd string, sa string, ch string")
    row = text.select(*files.pore_diameters(F.col("pd")), *files.surface_area(F.col("sa")), files.channel_dimension(F.col("ch")).alias("d")).first()
    assert (row.lcd, row.pld, row.lfpd, row.asa_a2, row.nasa_a2, row.d) == (5.1, 4.2, 5.0, 10.5, 1.0, 3)


def test_spectra(spark, tmp_path):
    (tmp_path / "dos.dat").write_text("# head\n1.0 2.0 3.0\n2.0 4.0 5.0\n")
    rows = files.densities_of_states(files.numbered_lines(spark, str(tmp_path / "dos.dat"))).collect()
    assert len(rows) == 4 and rows[0].frequency == pytest.approx(33.35641)
    (tmp_path / "vib").write_text("a\nb\nc\n1 x 10.5\n2 x 20.5\n$end\n")
    got = files.vibrational_frequencies(files.numbered_lines(spark, str(tmp_path / "vib"))).collect()
    assert [r.frequency for r in got] == [10.5, 20.5]
    (tmp_path / "mol.mol2").write_text("1 C1 0 0 0 C.3 1 x 0\n2 *2 1 0 0 Du 1 x 0\n")
    got = files.connection_points(files.numbered_lines(spark, str(tmp_path / "mol.mol2"))).orderBy("line_no").collect()
    assert [(r.label, r.type) for r in got] == [("C11", "C.3"), ("*22", "H")]


def test_user_models(spark):
    sites = spark.createDataFrame([(1, 0, 10.0, 2.0), (1, 1, 30.0, 4.0)], "structure_id long, site_idx int, mass double, f double")
    p = I.predict_sites(sites, {"a": lambda x: x["f"] * 1.0, "b": lambda x: x["f"] * 3.0}, ["f"])
    row = I.ensemble(p, ["structure_id"]).first()
    assert row.molar_mean == pytest.approx(6.0) and row.molar_std == pytest.approx(3.0) and row.gravimetric_mean == pytest.approx(0.3)
    v = I.predict_vectors(spark.createDataFrame([("x", [1.0, 2.0])], "name string, v array<double>"), {"s": ("v", lambda x: x.sum(axis=1))}, "name").first()
    assert v.s == 3.0


def test_streaming_adds_each_content_once(spark, tmp_path):
    from porelake.streaming.ingest import watch_structures

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.cif").write_text(TWO)
    run = lambda: watch_structures(spark, str(src), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    (src / "b.cif").write_text(TWO)
    run()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_writers(spark, tmp_path):
    import glob

    kept = spark.createDataFrame([("a_FSR", 5.0, 6.0, 7.0, 90.0, 90.0, 90.0, [("O1", "O", 0.1, 0.2, 0.3)])], "file_name string, a double, b double, c double, alpha double, beta double, gamma double, atoms array<struct<label:string,element:string,fx:double,fy:double,fz:double>>")
    files.write_structures(kept, str(tmp_path / "cif"))
    text = open(glob.glob(str(tmp_path / "cif" / "file_name=a_FSR" / "part*"))[0]).read()
    assert cif.structure(cif.parse(text)[0])["sites"][0][1] == "O"
    rows = spark.createDataFrame([("x", 1.0, [0.5])], "name string, min_dihedral double, ion_charges array<double>")
    files.write_summaries(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).columns == ["ion_charges", "name"]
    files.write_cleaning_table(rows, str(tmp_path / "csv"))
    files.write_cleaning_table(rows, str(tmp_path / "csv"), append=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    hist = spark.createDataFrame([(4, True, 0, 0.01, 3)], "number_of_linkers int, is_open boolean, bin int, centre double, n long")
    files.write_histogram(hist, str(tmp_path / "hist"))
    assert spark.read.text(str(tmp_path / "hist")).first()["value"] == "0.01 3"
