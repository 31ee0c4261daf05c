"""Dashboards from appended partial counts equal those from all rows, over batches and reruns."""

from pyspark.sql import functions as F

from auditlake.plans import dashboards as D
from auditlake.plans import partials as P
from auditlake.sources.adapters import Host


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_three_batches_and_a_rerun(spark, sf_dir, tmp_path):
    host, root = Host(spark, sf_dir), str(tmp_path)
    findings, metrics, scans, repositories = host.lines().cache(), host.metrics().cache(), host.scans(), host.repositories()
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for k in (0, 1, 2, 1):  # the second batch runs again
        P.append_findings(findings.filter(part == k), root, f"b{k}")
        P.append_metrics(metrics.filter(part == k), root, f"b{k}")
    found, sized = P.found(spark, root), P.sized(spark, root)
    assert found.agg(F.sum("n")).first()[0] == findings.count()
    pairs = [
        (P.findings_by(found, scans, "severity"), D.findings_by_severity(findings, scans)),
        (P.findings_by(found, scans, "language"), D.findings_by_language(findings, scans)),
        (P.findings_by_repository(found, scans, repositories), D.findings_by_repository(findings, scans, repositories)),
        (P.findings_by_repository(found, scans, repositories, True), D.findings_by_repository_language(findings, scans, repositories)),
        (P.quality_by_repository(sized, scans, repositories), D.quality_by_repository(metrics, scans, repositories)),
        (P.finding_density(found, sized, scans, repositories), D.finding_density(findings, metrics, scans, repositories)),
    ]
    for kept_up, whole in pairs:
        assert rows(kept_up) == rows(whole) and kept_up.count() > 0
