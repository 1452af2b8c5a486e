"""A cross-section of the registered queries against their SQL, and the coverage of the operator inventory."""

import re

import pytest

import __spark_entry__ as entry

from .oracle import compare, connect

SAMPLE = (
    "S1_flow_csv", "S5_code_cells", "S8_pattern_results", "P4_unknown_labels", "A2_protocol_by_category", "A5_correlation_matrix", "A10_class_report",
    "W1_top_services", "J4_severity_range_join", "N1_decide", "N1_decide_stream", "N2_decide_binary", "A19_check_summary", "R18_scenarios_per_file",
    "A20_check_scores", "K1_record_fixes", "H3_findings_for_run", "H5_show_run", "K6_sarif_results", "W2_turn_offsets", "R9_fit_before_split", "L1_audit",
    "M2_stratified_split", "M5_oversample", "A23_flip_rates", "T3_top_features",
)

INVENTORY = """
S1 S2 S3 S4 S5 S6 S7 S8 S9 S10 K1 K2 K3 K4 K5 K6 K7 K8 K9 P1 P2 P3 P4 P5 P6 P7 P8 P11 P12 P13 P14 P16 P17
J1 J2 J3 J4 J5 J6 J7 J8 J9 J10 J11 J12 J13 J14 A1 A2 A3 A4 A5 A6 A7 A8 A9 A10 A11 A12 A13 A14 A15 A16 A17 A18 A19 A20 A21 A22 A23 A24 A25 A26
W1 W2 W3 W4 W5 W6 W8 T1 T2 T3 T4 T5 T6 X1 X2 X3 X4 X5 C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C12 C14 C15 C16 C17 C18 C19 C20 C21 C22 C23 C24 C25
M1 M2 M3 M4 M5 M6 M7 M8 M9 M10 M11 M12 M13 N1 N2 N3 N4 N5 R0 R1 R2 R3 R4 R5 R6 R7 R8 R9 R10 R11 R12 R13 R14 R15 R16 R17 R18 R20 H1 H2 H3 H4 H5 U1 U2
""".split()


def test_every_operator_is_registered():
    have = {m.group() for name in entry.queries() if (m := re.match(r"[A-Z]\d+", name))}
    assert [i for i in INVENTORY if i not in have] == []


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) is None


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["severity", "action", "decisions"] and df.count() > 0
