import random

import pytest

from pathweave.llm import canonical as C
from pathweave.runtime import Scratch

REGISTRY = [(1, "UniProt", "UniProt Protein Knowledgebase", ["Swiss-Prot"]), (2, "ChEBI", "Chemical Entities of Biological Interest", None), (9, "LipidHarbor", "Lipid Harbor Structure Database", ["LHSDB"]), (46, "LectinHangar", "Lectin Hangar Sugar Binders", ["LHSBB"]), (10, "FluxBeacon", "Flux Beacon Reaction Rates", [])]
NAMES = [
    ("UniProt", 1), ("the uni-prot, ver. 2.3", 1), ("ＵｎｉＰｒｏｔ", 1), ("UniPrоt", 1), ("UnirPot", 1), ("Ünîprot #", 1), ("id: swiss prot", 1), ("chebi (release 2019)", 2), ("chemical entities of", 2), ("of biological interest chemical entities", 2),
    ("LHSDB", 9), ("lhsbb", 46), ("Harbor, Lipid", 9), ("lipid harb.", 9), ("FLUXEBAOCN", 10), ("reaction rates flux beacon", 10), ("12345", -1), ("x", -1), ("harbor notebook", -1), ("???", -1), ("n/a", -1), ("a" * 5000, -1),
]


#: Exact forms with words around them, from which wrapping is learned.
WRAPPED = [(w.format(n), k) for k, n, *_ in REGISTRY for w in ("the {}", "{} ver 1", "{}, ver. 2.3", "{} (release 2001)", "id: {}", "{} #")]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REGISTRY, "db_id int, db_name string, full_name string, synonyms array<string>")


def test_names(spark, registry):
    names = NAMES + WRAPPED
    df = spark.createDataFrame([(i, n, None if i % 2 else " ", "clash") for i, (n, _) in enumerate(names)], "submission_id bigint, src_db string, dst_db string, side string")
    rows = C.map_submissions(df, registry).collect()
    assert {r.submission_id: r.db_id for r in rows} == {i: k for i, (_, k) in enumerate(names)} and {r.side for r in rows} == {"src"}


def test_empty(spark, registry):
    schema = "submission_id bigint, src_db string, dst_db string"
    assert C.map_submissions(spark.createDataFrame([], schema), registry).count() == 0
    assert [r.db_id for r in C.map_submissions(spark.createDataFrame([(1, "UniProt", None)], schema), registry.limit(0)).collect()] == [-1]


@pytest.mark.parametrize("threshold", [0.15, 0.5, 0.8])
def test_join_against_brute_force(spark, threshold):
    random.seed(2)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(1, 9)))
    left, right = sorted({word() for _ in range(80)}), sorted({word() for _ in range(40)})
    pairs = lambda w: {w[i : i + 2] for i in range(len(w) - 1)} or {w}
    want = {(a, b): len(pairs(a) & pairs(b)) / len(pairs(a) | pairs(b)) for a in left for b in right}
    frame = lambda ws, c: spark.createDataFrame([(w, sorted(pairs(w))) for w in ws], f"{c} string, s array<string>")
    for hot in (C.HOT, 5):
        rows = C.set_similarity_join(frame(left, "l"), frame(right, "r"), threshold, Scratch(spark, "test"), hot).collect()
        assert {(r.l, r.r): round(r.jaccard, 9) for r in rows} == {k: round(v, 9) for k, v in want.items() if v >= threshold}
        assert len(rows) == len({(r.l, r.r) for r in rows})


def test_wrapping_words(spark, registry):
    typed = spark.createDataFrame([(C.words_of(n),) for n, _ in NAMES + WRAPPED], "words array<string>").distinct()
    assert {r.word for r in C.wrapping_words(typed, C.entry_forms(registry)).collect()} == {"the", "ver", "0", "release", "id"}


def test_swapped_letters_stay_close():
    similar = lambda a, b: len(set(C.tokens_of(a)) & set(C.tokens_of(b))) / len(set(C.tokens_of(a)) | set(C.tokens_of(b)))
    assert similar("uniprot", "unirpot") > 0.8 and similar("uniprot", "uniport") > 0.7 and similar("uniprot", "juniperbox") < C.SIMILAR
