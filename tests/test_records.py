"""Readers of structure files on written files, small splits included."""

import random

import pytest

from scorefold.sources import records


def atom(kind, serial, name, chain, resid, x, y, z, element=""):
    return f"{kind:<6}{serial:>5} {name:<4} ALA {chain}{resid:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00          {element:>2}"


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_atoms(spark, folder):
    lines = [
        atom("ATOM", 1, " CA", "A", 5, 1.5, -2.25, 3), atom("ATOM", 2, " CA", "B", 5, 9, 9, 9), atom("ATOM", 3, " CB", "A", 5, 1, 1, 1),
        atom("ATOM", 4, " CA", "A", 6, 4, 5, 6), atom("ATOM", 5, " CA", "A", 5, 7, 8, 9), atom("HETATM", 6, " CA", "A", 9, 1, 1, 1, "CA"),
        atom("ATOM", 7, " H1", "A", 7, 1, 1, 1, "H"), atom("ATOM", 8, " DX", "A", 7, 1, 1, 1), "ATOM      9  CA  ALA A  xx", "TER", "",
    ]
    (folder / "a.pdb").write_text("\n".join(lines))
    found = {(r.resid, r.x, r.y, r.z) for r in records.ca_atoms(spark, str(folder)).collect()}
    assert found == {(5, 7.0, 8.0, 9.0), (6, 4.0, 5.0, 6.0)}
    assert records.ca_atoms(spark, str(folder), None).count() == 2  # the last of the repeated numbers, whatever its chain
    heavy = [(r.element, r.chain, r.x) for r in records.heavy_atoms(spark, str(folder)).orderBy("at").collect()]
    assert heavy == [("C", "A", 1.5), ("C", "B", 9.0), ("C", "A", 1.0), ("C", "A", 4.0), ("C", "A", 7.0), ("CA", "A", 1.0)]


def record(name, atoms, end="\n"):
    rows = [f"{x:10.4f}{y:10.4f}{z:10.4f} {e:<3} 0  0" for x, y, z, e in atoms]
    return end.join([name, "  program", "", f"{len(atoms):>3}  0  0     0  0            999 V2000", *rows, "M  END", ""])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_molecules_are_read_once_across_the_edges_of_splits(spark, folder, end):
    rng = random.Random(1)
    want, texts = [], []
    for n in range(1, 60):
        atoms = [(round(rng.random() * 9, 4), 1.0, -2.0, rng.choice(["C", "N", "H", "Cl"])) for _ in range(n % 7)]
        texts.append(record(f"m_{n}", atoms, end))
        heavy = [(x, e) for x, _, _, e in atoms if e != "H"]
        if heavy:
            want.append((n, f"m_{n}", heavy))
    (folder / "a.sdf").write_bytes(f"$$$${end}".join([*texts, ""]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = records.molecules(spark, str(folder))
        assert spark.read.text(str(folder), lineSep="$$$$").rdd.getNumPartitions() > 5
        got = sorted((r.record, r.name, [(a.x, e) for a, e in zip(r.atoms, r.elements, strict=True)]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def plain_models(text):
    """(idx, name, score, affinity, atoms, molecule) of the models and the affinity of the file, line by line."""
    whole, models, cur, mode = None, [], None, None
    for line in text.splitlines():
        words = line.split()
        if line.startswith("AFFNTY") and len(words) > 1 and words[1].replace(".", "").replace("-", "").isdigit():
            whole = float(words[1])
            if cur:
                cur[3] = whole
        if line.startswith("MODEL"):
            cur, mode = [int(words[1]), None, None, None, [], []], "atoms"
            models.append(cur)
        elif cur is None or line.startswith("AFFNTY"):
            continue
        elif line.startswith(("ATOM", "HETATM", "TER")):
            cur[4].append(line)
        elif line.startswith("LIGAND"):
            mode = "meta"
        elif line.startswith("LSCORE"):
            if len(words) > 1 and words[1] != "bad":
                cur[2] = float(words[1])
        elif mode == "meta" and cur[1] is None and line.strip():
            cur[1], mode = line.strip(), "molecule"
        elif mode == "molecule":
            cur[5].append(line)
    return [(*m[:5], "\n".join(m[5])) for m in models], whole


@pytest.mark.parametrize("head", ["PFRMAT LG\nTARGET T1\nAFFNTY 5.5 pKi\n", ""])
def test_models(spark, folder, head):
    one = "MODEL 1\nPARENT N/A\nATOM      1  CA  ALA A   1\nTER\nLIGAND 001 LIG\nvina_seed_101\n     RDKit\n\n  1  0\n    0.0 C\nLSCORE 0.5 x\nM  END\nEND\n"
    two = "MODEL  2\nATOM      2  CA\nLSCORE bad\nLIGAND 001 LIG\n\n  name two  \nbody\nLIGAND 002 X\nignored\nLSCORE 0.25\nAFFNTY 7.0 pKi\nEND\n"
    three = "MODEL 3\nHETATM    1  C\nLSCORE\nAFFNTY none\nEND\n"
    texts = {"a.lg": head + one + two + three, "b.lg": head + two, "c.lg": head}
    for name, text in texts.items():
        (folder / name).write_text(text)
    found = {}
    for r in records.models(spark, str(folder)).collect():
        found.setdefault(r.file.rsplit("/", 1)[-1], []).append(((r.idx, r.name, r.score, r.affinity, r.atoms, r.molecule), r.file_affinity))
    for name, text in texts.items():
        models, whole = plain_models(text)
        got = sorted(found.get(name, []), key=lambda m: m[0][0])
        # the text of a model ends where the next one begins, without its line end
        assert [(*m[:5], m[5].rstrip("\n")) for m, _ in got] == [(*m[:5], m[5].rstrip("\n")) for m in models]
        assert {w for _, w in got} == ({whole} if models else set())
