from pyspark.sql import functions as F

from sieveloom.functions import boxes as B
from sieveloom.functions import parse as P
from sieveloom.functions import scores as S


def one(spark, expr, **cols):
    kinds = {str: "string", float: "double", int: "int", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in cols.items()))
    return df.select(expr).first()[0]


def test_number_reads_odd_cells(spark):
    cases = {" 1.5 ": 1.5, "1.8e-1": 0.18, "": None, "abc": None, "nan": None, "-": None, "inf": None, "1e309": None, "1.5f": None, " 7": 7.0}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v string")
    assert [r[0] for r in df.select(P.number("v")).collect()] == [*cases.values(), None]


def test_lenient_float_keeps_infinity(spark):
    df = spark.createDataFrame([("nan",), ("inf",), ("x",)], "v string")
    assert [r[0] for r in df.select(P.lenient_float("v")).collect()] == [None, float("inf"), None]


def test_clamp_and_gate(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (0.4,), (7.0,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(S.clamp01("v")).collect()] == [0, 0, 0, 0.4, 1, 0]
    assert [r[0] for r in df.select(S.quality_gate_value("v")).collect()][:3] == [0, float("inf"), 1]


def test_bins_on_edges_and_degenerate(spark):
    b = lambda v, a, c: one(spark, S.bin3(F.col("v"), S.lit(a), S.lit(c)), v=v)
    assert [b(1.0, 1, 2), b(2.0, 1, 2), b(0.5, 1, 2), b(5.0, 2, 2), b(float("nan"), 1, 2)] == [1, 2, 0, 0, 2]
    assert one(spark, S.bin_count(F.col("v"), [S.lit(1), S.lit(2)]), v=float("nan")) == 0


def test_subtype_missing_is_general(spark):
    e = S.subtype_fixed(F.col("a").try_cast("double"), F.col("b").try_cast("double"), F.col("c").try_cast("double"))
    assert one(spark, e, a="0.9", b="0.5", c="6") == "linear_scratch"
    assert one(spark, e, a="", b="0.5", c="6") == "general"
    assert one(spark, e, a="0.1", b="0.5", c="3") == "irregular"


def test_boxes(spark):
    assert one(spark, B.parse_xywh("b"), b="1, 2,3,4").asDict() == {"x": 1, "y": 2, "w": 3, "h": 4}
    assert one(spark, B.parse_xywh("b"), b="1,2,3") is None
    assert one(spark, B.parse_xywh("b"), b=None) is None
    assert one(spark, B.parse_xyxy("b"), b="(1, 2, 4, 6)").asDict() == {"x": 1, "y": 2, "w": 3, "h": 4}
    assert one(spark, B.parse_xywh_rounded("b"), b="1.5,2.5,3.2,4").asDict() == {"x": 2, "y": 2, "w": 3, "h": 4}
    assert one(spark, B.centroid_text(B.parse_xywh("b")), b="1,2,3,4") == "(2.5, 4.0)"
    box = B.parse_xywh("b")
    assert one(spark, B.rebase(box, F.lit(5), F.lit(0), F.lit(10), F.lit(10)), b="0,0,8,20").asDict() == {"x": 0, "y": 0, "w": 3, "h": 10}
    assert one(spark, B.rebase(box, F.lit(9), F.lit(0), F.lit(10), F.lit(10)), b="0,0,8,20") is None
    assert one(spark, B.yolo_line(F.lit(2), B.yolo(box, F.lit(100.0), F.lit(50.0))), b="10,10,20,20") == "2 0.200000 0.400000 0.200000 0.400000"


def test_prompt_words(spark):
    assert one(spark, S.context_words("k"), k="0_2_1_0_2") == "sharp edge directional surface background"
    assert one(spark, S.cell_bins("k"), k="none") == [0] * 5
    assert one(spark, S.cell_bins("k"), k="1_2") == [1, 2, 1, 1, 1]


def test_jitter_and_seed(spark):
    import hashlib

    j = one(spark, S.jitter(F.col("a"), F.col("b"), F.col("c")), a="p", b="1,2", c="0_0")
    want = int.from_bytes(hashlib.blake2b(b"p\x1f1,2\x1f0_0", digest_size=8).digest(), "big") / 2**64 * 1e-7
    assert j == want
    assert one(spark, S.content_seed(F.col("a")), a="k") == int(hashlib.sha1(b"k").hexdigest()[:15], 16)


def test_names(spark):
    assert one(spark, S.type_from_seed("a"), a="edge_chip_12") == "edge_chip"
    assert one(spark, S.class_number("a"), a="Class7") == 7
    assert one(spark, S.class_number("a"), a="burr") == 1
    assert one(spark, P.canonical_id("a"), a=" Crack-Shot_1.PNG\t") == "crack_shot_1"
    assert one(spark, P.canonical_class("a"), a="Edge chip ") == "edge_chip"
    assert one(spark, P.canonical_class("a"), a="_") is None


def test_numbers_have_no_letters(spark):
    cells = ["0x1p3", "1d", "2f", "1e3", "-.5", "+7.", " 3 ", "1_0", "NaN", "inf", "Infinity", "1e999", "", None, "--1", "1e", "\u0661"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(P.number("c")).collect()] == [None, None, None, 1000.0, -0.5, 7.0, 3.0] + [None] * 10
