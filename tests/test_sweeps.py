"""Sweeps over a written run."""

import json

import pytest

from scorefold.sources import sweeps


@pytest.fixture
def run(tmp_path):
    def put(path, value="data_x\n"):
        file = tmp_path / "my run" / "outputs" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(value if isinstance(value, str) else json.dumps(value))

    base = "boltz2/seed_7/boltz_results_x/predictions/input"
    put(f"{base}/input_model_0_aligned.cif")
    put(f"{base}/input_model_1_aligned.cif")
    put(f"{base}/input_model_x_aligned.cif")
    put(f"{base}/confidence_boltz_input_model_0.json", {"iptm": 0.5, "ptm": 0.25, "complex_plddt": 0.75, "confidence_score": 0.9})
    put(f"{base}/confidence_boltz_input_model_1.json", "{not json")
    put(f"{base}/affinity_input.json", {"affinity_pred_value": 1.5, "affinity_probability_binary": 0.5, "affinity_pred_value1": 2.5, "affinity_probability_binary1": 0.25, "affinity_pred_value2": 9})
    put("boltz2/boltz_results_y/predictions/a/a_model_0_aligned.cif")
    put("boltz2/boltz_results_y/predictions/a/affinity_a.json", {"affinity_pred_value": -1, "affinity_probability_binary": 1})
    put("boltz2x/boltz_results_y/predictions/a/affinity_a.json", {"affinity_pred_value": None, "affinity_probability_binary": 1})
    put("boltz2x/deep/er/affinity_a.json", {"affinity_pred_value": 1, "affinity_probability_binary": 1})
    put("protenix/s/t_sample_3_aligned.cif")
    put("protenix/s/t_summary_confidence_sample_3.json", {"iptm": 0.1, "plddt": 88.0, "ranking_score": 0.3})
    put("protenix/s/other_aligned.cif")
    put("alphafold3/j/m_aligned.cif")
    put("alphafold3/j/job_summary_confidences.json", {"iptm": 0.6, "ptm": 0.7, "ranking_score": 0.8, "plddt": 5})
    put("alphafold3/k/m_aligned.cif")
    put("alphafold3/k/m_summary_confidences.json", {"iptm": 0.9})
    put("other/z_aligned.cif")
    return str(tmp_path / "my run")


def test_places_and_confidences(spark, run):
    found = {(r.model, r.pose): (r.iptm, r.ptm, r.plddt, r.conf) for r in sweeps.confidences(spark, run).collect()}
    none = (None,) * 4
    assert found == {
        ("boltz2", 0): none, ("boltz2", 1): (0.5, 0.25, 75.0, 0.9), ("boltz2", 2): none, ("boltz2", 3): none, ("protenix", 0): none,
        ("protenix", 1): (0.1, None, 88.0, 0.3), ("alphafold3", 0): (0.6, 0.7, None, 0.8), ("alphafold3", 1): (0.9, None, None, None),
    }


def test_affinities(spark, run):
    assert {tuple(r) for r in sweeps.affinities(spark, run).collect()} == {("boltz2/seed_7", 1.5, 0.5), ("boltz2/seed_7/sample_1", 2.5, 0.25), ("boltz2/default", -1.0, 1.0)}
    assert {tuple(r) for r in sweeps.pose_affinities(spark, run).collect()} == {("boltz2", 0, -1.0, 1.0), ("boltz2", 1, 1.5, 0.5), ("boltz2", 2, 2.5, 0.25)}
