"""Column expressions that take names of sources, poses and residues apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of source names and their families, the first that fits counts.
FAMILIES = {
    "cofold_boltz2x_": "cofold_boltz2x",
    "cofold_boltz2_": "cofold_boltz2",
    "cofold_protenix_": "cofold_protenix",
    "cofold_af3_": "cofold_af3",
    "vina_cofolding": "vina_cofold",
    "vina_p2rank": "vina_p2rank",
    "vina_swinsite": "vina_swinsite",
    "vina_template_consensus": "vina_template_consensus",
    "autodock_gpu_template_consensus": "adg_template_consensus",
    "autodock_gpu_cofolding": "adg_cofold",
    "autodock_gpu_p2rank": "adg_p2rank",
    "autodock_gpu_swinsite": "adg_swinsite",
    "protenix_dock": "pxdock",
}
# Of names that hold "template_", the part that tells the family.
TEMPLATE_FAMILIES = {"_lig_align_": "template_lig_align", "_vina_": "template_vina", "_adg_": "template_adg"}
# The standard residues.
RESIDUES = {
    "A": "ALA", "R": "ARG", "N": "ASN", "D": "ASP", "C": "CYS", "Q": "GLN", "E": "GLU", "G": "GLY", "H": "HIS", "I": "ILE",
    "L": "LEU", "K": "LYS", "M": "MET", "F": "PHE", "P": "PRO", "S": "SER", "T": "THR", "W": "TRP", "Y": "TYR", "V": "VAL",
}


def first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    found = otherwise
    for holds, value in reversed(cases):
        found = F.when(holds, value).otherwise(found)
    return found


def source_family(source: Column) -> Column:
    """The family of a source; an unknown source is its own."""
    by_start = [(source.startswith(p), F.lit(f)) for p, f in FAMILIES.items()]
    by_part = [(source.contains("template_") & source.contains(p), F.lit(f)) for p, f in TEMPLATE_FAMILIES.items()]
    return first_of(by_start + by_part, source)


def report_family(source: Column) -> Column:
    """A source without its ligand (L, X and digits) and without its seed and what follows."""
    return F.regexp_replace(F.regexp_replace(source, r"_(L\d*|X\d*)$", ""), r"_seed[_-]\d+.*", "")


def pose_group(name: Column) -> Column:
    """A pose name without seed and index."""
    return F.regexp_replace(name, r"(_seed_\d+)?_\d+$", "")


def track(group: Column) -> Column:
    """0 cofolding, 1 docking at consensus sites, 2 docking on templates, 3 any other docking."""
    on_template = group.startswith("template_") & (group.contains("_vina") | group.contains("_adg"))
    return first_of([(group.startswith("cofold_"), F.lit(0)), (group.contains("template_consensus"), F.lit(1)), (on_template, F.lit(2))], F.lit(3))


def dock_kind(stem: Column) -> Column:
    """dlg, vina_embedded, cofold or other."""
    low = F.lower(stem)
    kind = lambda start, tag: low.startswith(start) | low.contains(f"_{tag}_") | low.endswith(f"_{tag}_l")
    return first_of([(kind("autodock_gpu", "adg"), F.lit("dlg")), (kind("vina", "vina"), F.lit("vina_embedded")), (low.startswith("cofold"), F.lit("cofold"))], F.lit("other"))


def source_and_seed(stem: Column) -> tuple[Column, Column]:
    """(source, seed): cut at the last ``_seed_`` if a number follows, else the stem and NULL."""
    seed = F.nullif(F.regexp_extract(stem, r"^.*_seed_(\d+)$", 1), F.lit(""))
    return F.when(seed.isNotNull(), F.regexp_extract(stem, r"^(.*)_seed_\d+$", 1)).otherwise(stem), seed.cast("int")


def without_ligand(source: Column, ligand: Column) -> Column:
    tail = F.concat(F.lit("_"), ligand)
    return F.when(source.endswith(tail), F.substring(source, F.lit(1), F.length(source) - F.length(tail))).otherwise(source)


def source_parts(source: Column, ligand: Column) -> Column:
    """Struct of family, box_source, template and track (0 cofolding, 1 docking, 2 template docking, 3 ligand alignment)."""
    base = without_ligand(source, ligand)
    template = F.nullif(F.regexp_extract(base, r"^template_([^_]+)_(.+)$", 1), F.lit(""))
    method = F.nullif(F.regexp_extract(base, r"^template_([^_]+)_(.+)$", 2), F.lit(""))
    known = first_of(
        [(method.isin("autodock_gpu", "adg"), F.lit("template_adg")), (method.isin("pxdock", "protenix_dock"), F.lit("template_pxdock")), (method.isNull(), F.lit("template_unknown"))],
        F.concat(F.lit("template_"), method),
    )
    is_template, vina, adg = base.startswith("template_"), base.startswith("vina_"), base.startswith("autodock_gpu_")
    family = first_of(
        [(base.startswith("cofold_"), base), (is_template, known), (vina, F.lit("vina")), (adg, F.lit("adg")), (base.startswith("protenix_dock") | (base == "pxdock"), F.lit("pxdock"))], base
    )
    box = F.nullif(first_of([(vina, F.regexp_replace(base, "^vina_", "")), (adg, F.regexp_replace(base, "^autodock_gpu_", ""))], F.lit(None).cast("string")), F.lit(""))
    number = first_of([(base.startswith("cofold_"), F.lit(0)), (is_template & F.coalesce(method == "lig_align", F.lit(False)), F.lit(3)), (is_template, F.lit(2))], F.lit(1))
    return F.struct(family.alias("family"), box.alias("box_source"), F.when(is_template, template).alias("template"), number.alias("track"))


def sample(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"sample[_-](\d+)", 1), F.lit("")).cast("int")


def stem(name: Column) -> Column:
    """A name without its trailing index; a name without one is its own stem."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*)_(\d+)$", 1), F.lit("")), name)


def ligand_of(tool: Column, known: list[str]) -> Column:
    """The longest known id that a tool's name ends in, or is; else NULL."""
    ids = sorted(known, key=lambda x: (-len(x), x))
    return first_of([(tool.endswith(f"_{i}") | (tool == i), F.lit(i)) for i in ids], F.lit(None).cast("string"))


def job_name(value: Column, default: str = "job") -> Column:
    """Runs of other characters than letters, digits, dot, underscore and dash become a dash; none at the ends."""
    clean = F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def residue(token: Column) -> tuple[Column, Column]:
    """(three-letter name or NULL, number) of ``SER195``, ``S195`` or ``195``."""
    name = F.upper(F.regexp_extract(token, r"^([A-Za-z]*)(\d+)$", 1))
    number = F.nullif(F.regexp_extract(token, r"^([A-Za-z]*)(\d+)$", 2), F.lit("")).cast("int")
    three = first_of([(name == one, F.lit(full)) for one, full in RESIDUES.items()], F.lit(None).cast("string"))
    head = F.substring(name, 1, 3)
    return F.when(head.isin(*RESIDUES.values()), head).otherwise(three), number


def modifications(spec: Column) -> Column:
    """Array of (position, code) of ``253:CSO,17:SEP``; blank entries are left out."""
    entries = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int").alias("position"), F.trim(F.split_part(x, F.lit(":"), F.lit(2))).alias("code")))


def evidence_weight(sources: Column, quality: list[Column], likeness: list[Column]) -> Column:
    """Number of sources + best quality + best likeness; what is missing counts 0."""
    best = lambda columns: F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.coalesce(sources, F.lit(0)) + best(quality) + best(likeness)


def shifted_id(number: Column) -> Column:
    """Ids up to 356 are the same, 357 became 356, later ones moved down by one; six digits."""
    moved = F.when(number <= 356, number).when(number == 357, F.lit(356)).otherwise(number - 1)
    return F.lpad(moved.cast("string"), 6, "0")


def flag(text: Column) -> Column:
    """true, 1, yes and on are true, whatever their case; anything else is false."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "on"), F.lit(False))


# Fixed values that reports depend on: labels by the start of a source, and of template sources by what they hold.
_COFOLD = {f"cofold_{m}_": f"cofold_{m}" for m in ("boltz2x", "boltz2", "protenix", "af3")}
REPORTS = {
    "score": (
        _COFOLD | {f"vina_{m}": f"vina_{m}" for m in ("cofolding", "p2rank", "swinsite")} | {f"autodock_gpu_{m}": f"adg_{m}" for m in ("cofolding", "p2rank", "swinsite")} | {"protenix_dock": "protenix_dock"},
        {"_lig_align_": "template_lig_align(MCS)", "_vina_": "template_vina", "_adg_": "template_adg"},
    ),
    "consensus": (
        _COFOLD | {"vina_cofolding": "vina_cofold", "vina_p2rank": "vina_p2rank", "vina_swinsite": "vina_swinsite"}
        | {"autodock_gpu_cofolding": "adg_cofold", "autodock_gpu_p2rank": "adg_p2rank", "autodock_gpu_swinsite": "adg_swinsite"} | {"protenix_dock": "pxdock"},
        {"_lig_align_": "template_lig_align", "_vina_": "template_vina", "_adg_": "template_adg"},
    ),
}


def report_label(source: Column, report: str) -> Column:
    """A source's family as the ``report`` (a key of REPORTS) names it; other sources are their own family."""
    starts, inside = REPORTS[report]
    known = [(source.startswith(p), F.lit(f)) for p, f in starts.items()]
    return first_of([*known, *[(source.contains("template_") & source.contains(p), F.lit(f)) for p, f in inside.items()]], source)


def ablation_family(source: Column) -> Column:
    """The cofolding model, the longest name first, else what stands before the first ``_seed``."""
    models = [(source.startswith(p[:-1]), F.lit(p[:-1])) for p in _COFOLD]
    return first_of(models, F.split_part(source, F.lit("_seed"), F.lit(1)))
