"""Readers against small files whose rows are worked out by hand."""

import json

from folioscope.sources import lines, reports


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_intervals(spark, tmp_path):
    p = put(tmp_path, "a.bed", "track name=x\n# note\nc1\t5\t9\nc1\t9\t5\nc2\t0\t4\tn\t1001\t+\nc2\t0\t4\tn\t10\t*\nc3\t0\t9\tn\t1\t+\t0\t9\t0\t2\t3,3,\t0,6,\nc3\t0\t9\tn\t1\t+\t0\t9\t0\t2\t3,3\t1,6\n")
    assert rows(lines.read_bed(spark, p), "chrom", "error") == sorted([("c1", None), ("c1", "interval"), ("c2", "score"), ("c2", "strand"), ("c3", None), ("c3", "blocks")], key=repr)
    p = put(tmp_path, "a.bg", "c1 0 5 1.5\nc1 0 5 x\nc1 0 5\n")
    assert rows(lines.read_bedgraph(spark, p), "dataValue", "error") == sorted([(1.5, None), (None, "value"), (None, "columns")], key=repr)
    p = put(tmp_path, "a.wig", "track type=wiggle_0\nfixedStep chrom=c1 start=10 step=5 span=2\n1\n2\nvariableStep chrom=c2\n7 3.5\n")
    assert rows(lines.read_wig(spark, p), "chrom", "chromStart", "chromEnd", "dataValue", "error") == [("c1", 10, 11, 1.0, None), ("c1", 15, 16, 2.0, None), ("c2", 7, 7, 3.5, None)]


def test_features_variants_alignments(spark, tmp_path):
    p = put(tmp_path, "a.gff3", "##gff-version 3\ns\tx\tgene\t1\t9\t.\t+\t.\tID=a\ns\tx\tCDS\t5\t2\t1.5\t-\t0\tID=b\n##FASTA\n>s\nACGT\n")
    assert rows(lines.read_gff(spark, p), "type", "start", "score", "attributes", "error") == [("CDS", 5, 1.5, "ID=b", "interval"), ("gene", 1, None, "ID=a", None)]
    p = put(tmp_path, "a.vcf", "##fileformat=VCFv4.3\n#CHROM\tPOS\n1\t7\t.\tA\tC,G\t50\tPASS\tDP=3\tGT\t0/1\t1/1\n1\tx\trs\tA\tC\t.\t.\t.\n")
    assert rows(lines.read_vcf(spark, p), "pos", "id", "qual", "samples", "error") == [(7, None, 50.0, ["0/1", "1/1"], None), (None, "rs", None, [], "position")]
    p = put(tmp_path, "a.sam", "@HD\tVN:1.6\nr1\t0\tc\t7\t60\t3M\t*\t0\t0\tACG\tIII\tNM:i:0\nr2\t0\tc\t7\t60\t3M\t*\t0\t0\tACG\tII\n")
    assert rows(lines.read_sam(spark, p), "qname", "tags", "error") == [("r1", ["NM:i:0"], None), ("r2", [], "quality")]


def test_sequences(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">one first thing\nACGT\nNN\n>two\n--\n")
    assert rows(lines.read_fasta(spark, p), "id", "description", "length", "gc", "ambiguous", "sequence") == [("one", "first thing", 6, "33.33", 2, "ACGTNN"), ("two", "", 2, "n/a", 2, "--")]
    p = put(tmp_path, "a.fq", "@r1 x\nACG\n+\n!I@\n@r2\nAC\n+\nI\n")
    assert rows(lines.read_fastq(spark, p), "id", "lowest_quality", "highest_quality", "error") == [("r1", 33, 73, None), ("r2", 73, 73, "length")]


def test_arff(spark, tmp_path):
    p = put(tmp_path, "a.arff", "@relation r\n@attribute 'a b' numeric\n@ATTRIBUTE c {x, 'y z'}\n@data\n% note\n1, 'y z'\n{1 x}\n?,x\n")
    assert rows(lines.read_arff(spark, p), "row", "attribute", "kind", "value") == [(0, "a b", "numeric", "1"), (0, "c", "nominal", "y z"), (1, "a b", "numeric", "0"), (1, "c", "nominal", "x"), (2, "a b", "numeric", None), (2, "c", "nominal", "x")]


def test_findings_and_requests(spark, tmp_path):
    rules = [{"id": "R0", "defaultConfiguration": {"level": "error"}}, {"id": "R1"}]
    run = {"tool": {"driver": {"name": "t", "rules": rules}}, "results": [{"ruleIndex": 0}, {"ruleId": "R1", "level": "note"}, {"ruleId": "R1"}, {"ruleId": "R1", "level": "none"}]}
    p = put(tmp_path, "a.sarif", json.dumps({"version": "2.1.0", "runs": [run]}))
    assert rows(reports.severities(reports.read_sarif(spark, p)), "tool", "rule", "error", "warning", "note", "other", "total") == [("t", "R0", 1, 0, 0, 0, 1), ("t", "R1", 0, 1, 1, 1, 3)]
    e = {"request": {"method": "GET", "url": "http://h/p?q=1&API-Key=z#f", "bodySize": 0}, "response": {"status": 200, "content": {"mimeType": "text/html", "size": 5}}, "time": 2.5}
    p = put(tmp_path, "a.har", json.dumps({"log": {"version": "1.2", "entries": [e]}}))
    assert rows(reports.read_har(spark, p), "url", "masked", "status", "response_bytes", "time_ms") == [("http://h/p?q=1&API-Key=***#f", 1, 200, 5, 2.5)]


def test_coverage(spark, tmp_path):
    p = put(tmp_path, "a.info", "TN:\nSF:/x/a.c\nFNF:2\nFNH:1\nDA:1,3\nDA:2,0\nBRDA:1,0,0,-\nBRDA:1,0,1,4\nend_of_record\nSF:b.c\nLF:0\nend_of_record\n")
    assert rows(reports.read_lcov(spark, p), "file", "lines_hit", "lines_missed", "functions_missed", "branches_hit", "branches_missed", "line_rate") == [("a.c", 1, 1, 1, 1, 1, "50.0%"), ("b.c", 0, 0, 0, 0, 0, "—")]
    p = put(tmp_path, "j.xml", '<report name="r"><package name="p"><class name="c"><counter type="LINE" missed="9" covered="9"/></class><counter type="LINE" missed="1" covered="3"/><counter type="CLASS" missed="0" covered="1"/></package></report>')
    assert rows(reports.read_coverage(spark, p), "package", "line_covered", "line_missed", "class_covered", "line_rate") == [("p", 3, 1, 1, "75.0%")]
    p = put(tmp_path, "c.xml", '<coverage><packages><package name="q"><classes><class name="c"><methods/><lines><line number="1" hits="2" branch="true" condition-coverage="50% (1/2)"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert rows(reports.read_coverage(spark, p), "package", "line_covered", "line_missed", "branch_covered", "branch_missed") == [("q", 1, 1, 1, 1)]


def test_suites_and_bad_xml(spark, tmp_path):
    p = put(tmp_path, "t.xml", '<testsuites><testsuite name="s" time="1.5"><testcase/><testcase><error/><failure/></testcase><testcase><skipped/></testcase></testsuite><testsuite/></testsuites>')
    assert rows(reports.read_junit(spark, p), "suite", "tests", "passed", "failures", "errors", "skips", "seconds") == [("(unnamed suite)", 0, 0, 0, 0, 0, 0.0), ("s", 3, 1, 1, 0, 1, 1.5)]
    p = put(tmp_path, "bad.xml", "<a><b></a>")
    assert rows(reports.xml_elements(spark, p), "id", "tag") == [(-1, "error")]


def test_graphs_and_maps(spark, tmp_path):
    p = put(tmp_path, "g.graphml", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph><node id="a"/><node id="b"/><edge source="a" target="b"/><edge source="a" target="z"/></graph></graphml>')
    nodes, edges = reports.read_graphml(spark, p)
    assert rows(nodes, "node") == [("a",), ("b",)] and rows(edges, "source", "target", "known") == [("a", "b", True), ("a", "z", False)]
    shapes = [{"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]], [[5, 5]]]}, {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[7, 8, 9]]}]}, None]
    p = put(tmp_path, "m.geojson", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g} for g in shapes]}))
    got = rows(reports.read_geojson(spark, p), "feature", "type", "part", "ring", "ord", "lon", "lat")
    assert got == [(0, "Point", 0, 0, 0, 1.0, 2.0), (1, "Polygon", 0, 0, 0, 0.0, 0.0), (1, "Polygon", 0, 0, 1, 1.0, 0.0), (1, "Polygon", 0, 0, 2, 0.0, 0.0), (1, "Polygon", 0, 1, 0, 5.0, 5.0), (2, "LineString", 0, 0, 0, 7.0, 8.0)]
