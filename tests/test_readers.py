"""Readers on small files written here."""

import gzip
import json

from omicspark.sources import readers as R
from omicspark.sources import sinks
from tests.conftest import rows


def put(path, text):
    path.write_text(text)
    return str(path)


def test_23andme(spark, tmp_path):
    p = put(tmp_path / "ann.txt", "# made up\n# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\ni5\tX\tbad\tA\nrs2\t1\t200\t--\nxx\t1\t3\tAA\n")
    assert rows(R.read_23andme(spark, p)) == [("ann", "i5", "X", 0, "A"), ("ann", "rs1", "1", 100, "AG")]


def test_ancestry_tab_and_comma(spark, tmp_path):
    a = put(tmp_path / "a.txt", "#AncestryDNA\nrsid\tchromosome\tposition\tallele1\tallele2\nrs1\t1\t5\tA\tC\nrs2\t1\t6\t0\t0\n")
    b = put(tmp_path / "b.txt", "#c\nRSID,CHROMOSOME,POSITION,ALLELE1,ALLELE2\nrs9,2,7,T,T\n")
    assert rows(R.read_ancestry(spark, a)) == [("a", "rs1", "1", 5, "AC")]
    assert rows(R.read_ancestry(spark, b)) == [("b", "rs9", "2", 7, "TT")]


def test_myheritage(spark, tmp_path):
    p = put(tmp_path / "m.csv", '# x\nRSID,CHROMOSOME,POSITION,RESULT\n"rs1","1","11","GG"\n"rs2","1","12","--"\n')
    assert rows(R.read_myheritage(spark, p)) == [("m", "rs1", "1", 11, "GG")]


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t10\trs1\tA\tG\t50\tPASS\tAF=0.1;DB\tGT:DP\t0/1:9\t1|1:8\n1\t20\t.\tC\tT,G\t.\tq10;s50\t.\tGT\t./1\t1/2\nX\t5\trs3\tG\tA\t9\tPASS\tAF=0.5\tDP:GT\t3:1\t4:0\n"


def test_vcf(spark, tmp_path):
    p = put(tmp_path / "v.vcf", VCF)
    assert rows(R.read_vcf_genotypes(spark, p)) == [("v", ".", "1", 20, "T"), ("v", "rs1", "1", 10, "AG"), ("v", "rs3", "X", 5, "A")]
    assert rows(R.read_vcf_dosages(spark, p)) == [("s1", "1:20", "1", 20, None), ("s1", "rs1", "1", 10, 1), ("s1", "rs3", "X", 5, 2), ("s2", "1:20", "1", 20, 2), ("s2", "rs1", "1", 10, 2), ("s2", "rs3", "X", 5, 0)]
    got = {(r.variant_id, r.alt): (r.qual, r.filter, r.info) for r in R.read_vcf_alleles(spark, p).collect()}
    assert got[("rs1", "G")] == (50.0, ["PASS"], {"AF": "0.1", "DB": "true"})
    assert got[("1:20:C:T,G", "G")] == (None, ["q10", "s50"], {})


def test_detect_format(spark, tmp_path):
    put(tmp_path / "v.vcf", VCF)
    put(tmp_path / "a.txt", "#AncestryDNA raw data\nrsid\tchromosome\tposition\tallele1\tallele2\n")
    put(tmp_path / "t.txt", "# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t1\tAA\n")
    put(tmp_path / "u.txt", "hello\n")
    assert rows(R.detect_format(spark, str(tmp_path))) == [("a", "ancestry"), ("t", "23andme"), ("u", "unknown"), ("v", "vcf")]


def test_scores_and_sumstats(spark, tmp_path):
    p = put(tmp_path / "PGS1.txt", "#pgs_id=PGS1\nrsID\tchr_name\teffect_allele\tother_allele\teffect_weight\tallelefrequency_effect\nrs1\t1\tg\tA\t0.5\t0.2\nrs2\t1\tT\tC\tx\t\n1:5\t1\tT\tC\t1\t\n")
    assert rows(R.read_pgs_scores(spark, p)) == [("PGS1", "rs1", "G", "A", 0.5, 0.2)]
    p = put(tmp_path / "s.tsv", "SNP\tCHR\tBP\tBETA\tSE\tP\nrs1\tchr1\t10\t0.2\t0.1\t0.05\nrs2\tchr1\t90\t0.2\t0\t1\nrs3\tchr2\t10\t-0.3\t0.1\t0.01\n")
    got = [(r.rsid, r.chrom, r.pos, round(r.z, 6)) for r in R.read_sumstats(spark, p).orderBy("rsid").collect()]
    assert got == [("rs1", "1", 10, 2.0), ("rs3", "2", 10, -3.0)]
    assert R.read_sumstats(spark, p, "1", 0, 50).count() == 1
    p = put(tmp_path / "r.regenie", "CHROM GENPOS ID ALLELE0 ALLELE1 A1FREQ INFO N TEST BETA SE CHISQ LOG10P EXTRA\n1 5 rs1 A G 0.1 1 100 ADD 0.5 0.1 25 6 NA\n1 6 rs2 A G 0.1 1 100 ADD 0.5 0.1 25 0 NA\nshort line\n")
    r = R.read_regenie(spark, p).collect()
    assert [(x.variant_id, x.beta, round(x.p, 9)) for x in r] == [("rs1", 0.5, 1e-6)]


def test_eigenstrat(spark, tmp_path):
    ind, snp, geno = put(tmp_path / "a.ind", "i1 M P1\ni2 F P2\n"), put(tmp_path / "a.snp", "rs1 1 0.0 100 A G\nrs2 1 0.0 200 C T\n"), put(tmp_path / "a.geno", "02\n91\n")
    assert rows(R.read_eigenstrat(spark, ind, snp, geno)) == [("i1", "P1", "rs1", "1", 100, 0), ("i1", "P1", "rs2", "1", 200, None), ("i2", "P2", "rs1", "1", 100, 2), ("i2", "P2", "rs2", "1", 200, 1)]


def test_matrices(spark, tmp_path):
    p = put(tmp_path / "c.csv", "gene,s.1,s2\ng1,5,\ng2,0,7\n")
    assert rows(R.read_matrix(spark, p)) == [("g1", "s.1", 5.0), ("g1", "s2", None), ("g2", "s.1", 0.0), ("g2", "s2", 7.0)]
    p = put(tmp_path / "p.tsv", "Protein IDs\tLFQ intensity a\tLFQ intensity b\tReverse\nP1\t5\t0\t\nP2\t4\t4\t+\nP3\t0\t0\t\n")
    assert rows(R.read_protein_groups(spark, p)) == [("P1", "a", 5.0), ("P1", "b", None)]
    p = put(tmp_path / "d.tsv", "Protein.Ids\tGenes\tx.raw\nP1\tG1\t3.5\nP2\t\t\n")
    assert rows(R.read_diann(spark, p)) == [("G1", "x.raw", 3.5), ("P2", "x.raw", None)]
    p = put(tmp_path / "n.csv", "SampleID,OlinkID,NPX,QC_Warning\na,O1,1.5,PASS\nb,O1,2,WARN\nb,O2,2,PASS\n")
    assert rows(R.read_olink_npx(spark, p)) == [("a", "O1", 1.5, None)]


def test_10x(spark, tmp_path):
    put(tmp_path / "matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n%c\n2 2 3\n1 1 4\n2 1 1\n2 2 3\n")
    with gzip.open(tmp_path / "features.tsv.gz", "wt") as f:
        f.write("E1\tg1\tx\nE2\tg2\tx\n")
    put(tmp_path / "barcodes.tsv", "c1\nc2\n")
    assert rows(R.read_10x_mtx(spark, str(tmp_path))) == [("c1", "g1", 4), ("c1", "g2", 1), ("c2", "g2", 3)]


def test_reports(spark, tmp_path):
    p = put(tmp_path / "b.tsv", "name\ttaxonomy_id\ttaxonomy_lvl\tnew_est_reads\tfraction_total_reads\nE. coli\t1\tS\t10\t0.5\nBacteria\t2\tD\t20\t1\n")
    assert rows(R.read_bracken(spark, p)) == [("b", "E. coli", 10, 0.5)]
    p = put(tmp_path / "r.tsv", "Best_Hit_ARO\tDrug Class\tCut_Off\nNDM-1\tcarbapenem\tPerfect\nX\ty\tLoose\n")
    assert rows(R.read_rgi(spark, p)) == [("r", "NDM-1", "carbapenem", "Perfect")]
    p = put(tmp_path / "f.fa", ">a first one\nacg\nTT\n>b\nGG\n")
    assert rows(R.read_fasta(spark, p)) == [("a", "first one", "ACGTT"), ("b", "", "GG")]
    p = put(tmp_path / "m.json", json.dumps({"report_general_stats_data": [{"s": {"q": 1.0, "r": 2.0}}, {"s": {"q": 3.0}}]}))
    assert rows(R.read_multiqc_general_stats(spark, p)) == [("s", "q", 3.0), ("s", "r", 2.0)]
    p = put(tmp_path / "e.json", json.dumps({"gene": {"symbol": "G"}, "relatedChemicals": [{"name": "a"}, {"name": "b"}], "levelOfEvidence": {"term": "1A"}}))
    assert rows(R.read_evidence_json(spark, p)) == [("G", "a, b", "1A", None)]
    assert len(R.file_checksums(spark, p).first()["sha256"]) == 64


def test_trials(spark, tmp_path):
    p = put(tmp_path / "t.json", json.dumps({"protocolSection": {"identificationModule": {"nctId": "NCT00000001", "briefTitle": "T"}, "statusModule": {"overallStatus": "RECRUITING", "startDateStruct": {"date": "2020-05"}}, "designModule": {"phases": ["PHASE1", "PHASE2"]}, "conditionsModule": {"conditions": ["c"]}}}))
    t = R.read_trials_json(spark, p)
    r = t.first()
    assert (r.nct_id, r.phase, r.conditions, r.interventions) == ("NCT00000001", "PHASE1 / PHASE2", ["c"], [])
    study = sinks.research_studies(t).first()
    assert study.valid and json.loads(study.resource)["period"] == {"start": "2020-05"}


def test_sheets(spark):
    df = spark.createDataFrame([(1, "s1", " ", "p1"), (2, "s1", "n1", "p2"), (3, None, "x", None)], "i int, Sample_ID string, Sample_Name string, Project string")
    assert rows(R.normalise_sample_sheet(df, "i")) == [("s1", "n1", "p1", None)]
    df = spark.createDataFrame([("r", "Pct_Q30", "91.5%"), ("r", "Yield", "100"), ("r", "odd", "x")], "run string, key string, value string")
    assert rows(R.normalise_run_qc(df)) == [("r", 91.5, 100.0, None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "1", 5, 9, 3.25, "n")], "sample_id string, chrom string, start long, end long, score double, name string")
    sinks.write_bed(df, str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).first()[0] == "1\t5\t9\tn\t3.25"
    sinks.write_tables({"a": df}, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t/a")).count() == 1


def test_evidence_rows(spark, tmp_path):
    p = put(tmp_path / "e.json", '{"accessionId": "PA1", "id": "x", "relatedChemicals": [{"name": "a"}, {"name": "b"}], "relatedGenes": [{"symbol": "G"}, {}], "levelOfEvidence": {"term": "1A"}, "phenotypeCategory": "Toxicity"}\n{"id": "2", "name": "N", "source": "S", "dosingInformation": true, "testingLevel": "Required"}\n')
    assert rows(R.read_evidence_rows(spark, p, "annotation")) == [("", "", "2", "", ""), ("G, ", "a, b", "PA1", "1A", "Toxicity")]
    assert rows(R.read_evidence_rows(spark, p, "guideline")) == [("", "", "2", "N", "S", True), ("G, ", "a, b", "x", "", "", False)]
    assert rows(R.read_evidence_rows(spark, p, "label"))[0] == ("", "", "2", "N", "S", "Required")


def test_summary_statistics_in_order(spark, tmp_path):
    from omicspark.sources import sinks

    df = spark.createDataFrame([("1", 10 * i, f"rs{i}", "A", "G", 0.25, 100, 0.1, 0.02, 25.0, float(i % 7), 10.0 ** -(i % 7)) for i in range(50)], "chrom string, pos long, variant_id string, allele0 string, allele1 string, a1freq double, n long, beta double, se double, chisq double, log10p double, p double").repartition(4)
    sinks.write_gwas(df, str(tmp_path / "s"))
    got = [line for f in sorted((tmp_path / "s").glob("*.csv")) for line in f.read_text().splitlines()]
    names = "CHROM\tPOS\tID\tA0\tA1\tA1FREQ\tN\tBETA\tSE\tCHISQ\tLOG10P\tP"
    lines = [x.split("\t") for x in got if x != names]
    assert got[0] == names and len(lines) == 50
    assert [float(x[10]) for x in lines] == sorted((float(i % 7) for i in range(50)), reverse=True) and lines[0][5:] == ["0.250000", "100", "0.100000", "0.020000", "25.000000", "6.000000", "1.00e-06"]
    sinks.write_gwas(df, str(tmp_path / "l"), sinks.LEADS)
    assert next(iter(sorted((tmp_path / "l").glob("*.csv")))).read_text().splitlines()[0] == "CHROM\tPOS\tID\tA0\tA1\tBETA\tSE\tP\tLOG10P"
