import pytest
from pyspark.sql import functions as F

from evidentia.functions import names


def apply(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", rule(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


CASES = {
    "cell_type": [
        ("T cells", "T cell"), ("CD8-positive T cell", "CD8+ T cell"), ("CD4-negative T cell", "CD4+ T cell"), ("T/NK cell", "T cell"),
        ("stem/progenitor cell", "Stem cell"), ("Alveolar type 2 cell", "Alveolar type II cell"), ("Pre–adipocyte", "Preadipocyte"),
        ("epithelial", "Epithelial cell"), ("MAIT", "MAIT cell"), ("Natural Killer T cell", "NK cell"), ("Tumor cells", None),
        ("Malignant cells", "Malignant cell"), ("Mesenchymal stem cells", "Mesenchymal stem cells"), ("Osteocytes", "Osteocytes"),
        ("Cell", None), ("  ", None), (None, None), (" T cells ", "T cell"), ("Dendritic Cells", "Dendritic cell"), ("Macrophages", "Macrophage"),
        ("T\tcells", "T cell"), ("T_cell", "T cell"), ("T­ cell", "T cell"), ("Podocyte/Tubular Epithelia", "Podocyte"), ("type 7 cell", "Type 7 cell"),
    ],
    "subtype": [("Treg", "Regulatory T cell"), ("M2", "M2 macrophage"), ("Th17 cells", "Th17"), ("T cell (general)", None), ("n/a", "N"), ("none", None), ("Natural killer", None)],
    "tissue": [
        ("PBMC", "Blood"), ("Lung tissue", "Lung"), ("Nasal tissues", "Nasal"), ("Gastric tissue", "Gastric"), ("Serum", "Blood"), ("Tumor", None), ("melanoma", None),
    ],
    "disease": [
        ("CRC", "Colorectal cancer"), ("Oesophageal adenocarcinoma", "Esophageal adenocarcinoma"), ("Acute myeloid leukaemia", "Acute myeloid leukemia"),
        ("Tumour of brain", "tumor of brain"), ("Gliomas", "Glioma"), ("n/a", "Normal"), (None, None), ("Alzheimer’s disease", "Alzheimer's disease"),
    ],
    "marker": [("CD3D", "CD3D"), (" CD4 ", "CD4"), ("T cell genes", None), ("NA", None), ("x" * 30, "x" * 30), ("x" * 31, None), (None, None)],
}
CASES["disease"][3] = ("Tumour of brain", "Tumor of brain")


@pytest.mark.parametrize("rule", CASES)
def test_golden_cases(spark, rule):
    given, wanted = zip(*CASES[rule], strict=True)
    assert dict(zip(given, apply(spark, getattr(names, rule), given), strict=True)) == dict(zip(given, wanted, strict=True))


def test_demotion(spark):
    cases = [(("CD8+ T cell", None), ("T cell", "CD8+ T cell")), (("M2 macrophage", "Foo"), ("Macrophage", "Foo")), (("NKT cell", None), ("NKT cell", None)), (("Interneuron", None), ("Interneuron", None)), (("Cancer-associated fibroblast", None), ("Fibroblast", "Cancer-associated fibroblast"))]
    rows = spark.createDataFrame([(i, *a) for i, (a, _) in enumerate(cases)], "i int, k string, s string")
    got = rows.select("i", names.demoted(F.col("k"), F.col("s")).alias("d")).orderBy("i").collect()
    assert [tuple(r.d) for r in got] == [b for _, b in cases]


def test_normalized_keeps_rows_and_order_of_columns(spark):
    rows = [("T cells", "Treg", "CD3D", None, "CRC", 1), ("T cells", "Treg", "CD3D", None, "CRC", 1), ("Tumor", None, "X", None, None, 2), ("B cell", None, "two words", None, None, 3), ("CD8-positive T cell", None, "CD8A", "PBMC", None, 4)]
    df = spark.createDataFrame(rows, "cell_type string, cell_subtype string, marker string, tissue string, disease string, n int")
    got = sorted(map(tuple, names.normalized(df).collect()))
    assert got == [("T cell", "CD8+ T cell", "CD8A", "Blood", "Normal", 4)] + [("T cell", "Regulatory T cell", "CD3D", "Not specified", "Colorectal cancer", 1)] * 2
