import random

from tests.llm import brute
from tidemark.llm import license_scan as op

SF = "/root/testdata/sf0.01"
MIT = op.TEMPLATES[1][1]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_base_columns_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(op.scan(docs))
    want = brute.licenses([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((x[:6] for x in got), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, x[5].split(","))) <= set(x[6].split(",")) for x in got)
    assert any("gpl-3" in x[6] for x in got) and all(0 <= x[7] <= 1 for x in got)
    gpl = {r.doc_id for r in docs.collect() if "GNU General Public License, version 3." in r.text}
    assert {x[0] for x in got if "gpl-3" in x[6].split(",")} == gpl


def test_edge_cases(spark):
    filler = " ".join(f"word{i}" for i in range(2000))
    data = [(1, None), (2, ""), (3, "Under the MIT license under THE mit-license"), (4, f"{filler} {MIT} {filler}"), (4, f"{filler} {MIT} {filler}"), (5, MIT.replace("hereby", "never")), (None, "cc by-nc, CC BY NC"), (6, "under the mit"), (7, "license granted copy of this")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in data], "doc_id long, text string, labels string")
    got = rows_of(op.scan(docs))
    assert sorted((x[:6] for x in got), key=repr) == sorted(brute.licenses(data), key=repr)
    assert {x[0]: x[6] for x in got} == {1: "", 2: "", 3: "mit", 4: "mit", 5: "", None: "cc-by-nc", 6: "", 7: ""}
    assert op.scan(docs.limit(0)).count() == 0


def test_a_licence_that_every_document_carries(spark):
    docs = spark.createDataFrame([(i, f"page{i} {MIT} end{i}") for i in range(40)], "doc_id long, text string")
    assert {(r.labels, r.score) for r in op.scan(docs).collect()} == {("mit", 1.0)}


def test_two_licences_and_a_long_text_of_licence_words(spark):
    gpl = op.TEMPLATES[5][1]
    prose = " ".join(w for i, w in enumerate(op.Index().vocabulary * 3) if i % 2)
    data = [(1, f"{MIT} {gpl}"), (2, f"{prose} {gpl} {prose}"), (3, " ".join(x[1] for x in op.TEMPLATES)), (4, MIT)] + [(10 + i, gpl) for i in range(30)]
    got = {r.doc_id: set(r.labels.split(",")) for r in op.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: {"mit", "gpl-3"}, 2: {"gpl-3"}, 3: {x[0] for x in op.TEMPLATES}, 4: {"mit"}} | {10 + i: {"gpl-3"} for i in range(30)}


def test_labels_of_the_method_equal_brute_force(spark):
    rng = random.Random(8)
    index, data = op.Index(), []
    for i in range(150):  # templates with words changed, dropped and added, in prose of licence words
        text = []
        for _ in range(rng.randint(1, 3)):
            text += rng.choices(index.vocabulary, k=rng.randint(0, 12))
            words = op.words_of(rng.choice(op.TEMPLATES)[1])
            for _ in range(rng.randint(0, max(1, len(words) // 4))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.choices(["other", "the", "license", "version"], k=rng.choice((1, 1, 1, 0)))
                words = words or ["x"]
            text += words
        data.append((i, " ".join(text)))
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in op.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    some = 0
    for i, text in data:
        found = brute.license_labels(text, index, op.MIN_SCORE, op.SLACK)
        base = set(filter(None, got[i][0].split(",")))
        assert set(filter(None, got[i][1].split(","))) == base | set(found)
        assert abs(got[i][2] - max([1.0] * bool(base) + list(found.values()), default=0)) < 1e-9
        some += len(found)
    assert some > 100


def test_five_of_a_hundred_files_carry_a_header(spark):
    header = " ".join(x[1] for x in op.TEMPLATES if x[0] == "apache-2")
    docs = spark.createDataFrame([(i, f"file {i} {header if i % 20 == 0 else 'plain'} text") for i in range(1000)], "doc_id long, text string")
    assert {r.doc_id for r in op.scan(docs).filter("labels = 'apache-2'").collect()} == set(range(0, 1000, 20))
