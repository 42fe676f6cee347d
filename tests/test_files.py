import pytest

from scorefold.sources import files


@pytest.fixture
def write(tmp_path):
    def put(text):
        path = tmp_path / "file"
        path.write_text(text)
        return str(path)

    return put


def test_hits(spark, write):
    row = "\t".join(["q", "1ABC_B", "30.5", *["0"] * 7, "1e-5", "50", "9", "9"])
    found = files.model_hits(spark, write(f"{row}\n{row}\t0.7\t0.8\nshort\trow\n")).orderBy("lddt").collect()
    assert [(r.entry, r.chain, r.pident, r.evalue, r.lddt, r.tmscore) for r in found] == [("1abc", "B", 30.5, 1e-5, 0.0, 0.0), ("1abc", "B", 30.5, 1e-5, 0.7, 0.8)]
    assert [tuple(r) for r in files.named_or_raw_hits(spark, write(row + "\n")).collect()] == [("1abc", "1ABC_B", "30.5")]
    named = files.named_or_raw_hits(spark, write("query\ttarget\tpdb_id\tpident\nq\t2DEF_A\t2def\t99\n"))
    assert [tuple(r) for r in named.collect()] == [("2def", "2DEF_A", "99")]
    kept = files.hits_with_ligands(spark, write("pdb_id\tnum_ligands\n1abc\t1\n2def\t0\n3ghi\tx\n4jkl\t2\n"))
    assert [r.pdb_id for r in kept.collect()] == ["1abc", "4jkl"]


def test_labels_submissions_and_clusters(spark, write):
    assert {tuple(r) for r in files.truth(spark, write("CASP ID,binding\nL1,true\nL2,FALSE\nL3,\n"), "CASP ID").collect()} == {("L1", True), ("L2", False), ("L3", None)}
    with pytest.raises(Exception, match="binding"):
        files.truth(spark, write("CASP ID,other\nL1,x\n"), "CASP ID")
    assert {tuple(r) for r in files.submission(spark, write("L1  0.5\tnote\nL2\nL1 0.7\n\nL3 bad\n")).collect()} == {("L1", 0.7), ("L3", None)}
    assert {tuple(r) for r in files.clusters(spark, write("a\ta\na\tb\nc\tc\n")).collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1)}


def test_components_and_pockets(spark, write):
    text = 'id,code,smiles,n,code,smiles,n\nT1, LIG ,"C,C",2,ZN,[Zn],\nT2,,C,1,\n'
    assert [tuple(r) for r in files.components(spark, write(text)).orderBy("id", "nth").collect()] == [("T1", 0, "LIG", "C,C", 2), ("T1", 1, "ZN", "[Zn]", 1)]
    text = "name , center_x, center_y, center_z, score\np1 , 1.0, 2.0, 3.0, 9.5\np2 , 4, 5, 6, \np3 , 7, 8, 9, 1\n"
    assert [tuple(r) for r in files.pockets(spark, write(text), 2).orderBy("rank").collect()] == [(1, 1.0, 2.0, 3.0, 9.5), (2, 4.0, 5.0, 6.0, 0.0)]


def test_the_last_of_a_tools_repeated_predictions_counts(spark, tmp_path):
    from scorefold.sources import tables

    (tmp_path / "ba_vina.tsv").write_text("Name\tpKd\na\t5\nb\tbad\na\t7.5\n \t1\nc\t2\n")
    (tmp_path / "ba_af3.tsv").write_text("Name\tpKd\na\t1\n")
    found = tables.predictions(spark, f"{tmp_path}/ba_*.tsv", "ba_", ["pKd"]).collect()
    assert {tuple(r) for r in found} == {("vina", "a", 7.5), ("vina", "c", 2.0), ("af3", "a", 1.0)}


def test_links_alignments_and_metrics(spark, tmp_path):
    pages = spark.createDataFrame([(1, '<a href="target.cgi?id=7&x"> r2001 </a><A HREF="target.cgi?id=8">D2002<'), (2, '<a href="target.cgi?id=1">R2001</a><a href="target.cgi?id=9">r2001</a>'), (3, None)], "id long, html string")
    found = files.named_links(pages, "id", "html", r'(?i)target\.cgi\?id=(\d+)[^"]*"[^>]*>\s*([RTHDML]2\d{3})\s*<')
    assert {tuple(r) for r in found.collect()} == {(1, "R2001", "7"), (1, "D2002", "8"), (2, "R2001", "9")}
    (tmp_path / "a.csv").write_text("key,sequence\nk0,AB,C\nbroken\n7,DEF\n")
    (tmp_path / "b.csv").write_text("other\nx,y\n")
    rows = files.alignment_records(spark, f"{tmp_path}/*.csv").orderBy("nth").collect()
    assert [(r.nth, r.header, r.sequence) for r in rows] == [(0, ">query", "AB,C"), (2, ">seq_2_key_7", "DEF")]
    (tmp_path / "rmsd_pred_a.tsv").write_text("Name\tpRMSD\tIs_Above_2A\na_10_10\t1.5\t0.2\nb_2_3\tnan\t0.5\na_10\tx\t0.3\n \t1\t1\n")
    (tmp_path / "ba_pred_a.tsv").write_text("Name\tpKd\na_10\t6\nc\t\n")
    families = {f"{tmp_path}/rmsd_pred_*.tsv": {"pRMSD": "prmsd", "Is_Above_2A": "above"}, f"{tmp_path}/ba_pred_*.tsv": {"pKd": "pkd", "Kcal/mol": "kcal"}}
    found = {r.name: (r.prmsd, r.above, r.pkd, r.kcal) for r in files.pose_metrics(spark, families).collect()}
    assert found == {"a_10": (1.5, 0.3, 6.0, None), "b_2_3": (None, 0.5, None, None), "c": (None,) * 4}
