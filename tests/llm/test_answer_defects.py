import pytest
from pyspark.sql import functions as F

from docgauge.llm import answer_defects
from docgauge.llm.answer_defect_queries import SQL, p1_audit
from docgauge.llm.answer_defects import defective_questions, fit_languages, judged_pairs, strange_language, telling_words
from tests.oracle import assert_same, connect

KIND = "question_id long, question string, prediction string, reference_answers array<string>, at long"
Q = "What reason is given for the change to the blue permit?"
R = ["because too few people returned the survey form"]
CASES = [
    (None, R, "empty"), ("", R, "empty"), (" \n​", R, "empty"), ("Answer:", R, "empty"), ("<answer></answer>", R, "empty"), ("**  **", R, "empty"), ("-", R, "empty"),
    ("None", ["None"], None), ("None", R, "empty"),
    ("I cannot determine this from the image.", R, "refusal"), ("Je ne sais pas.", R, "refusal"), ("Das lässt sich dem Bild nicht entnehmen.", R, "refusal"),
    ("No es posible leer la imagen.", R, "refusal"), ("Unanswerable", R, "refusal"), ("cannot be determined before the audit", ["cannot be determined before the audit"], None),
    (Q, R, "question_copy"), (f"Q: {Q} A:", R, "question_copy"), (f'"{Q.upper()}"', R, "question_copy"), (Q[:-1], R, "question_copy"),
    (f"{Q}\nAnswer the question using a single word or phrase.", R, "question_copy"), (f"{Q} {R[0]}", R, None),
    ("because too few people returned the sur", R, "truncated"), ("because too few people returned the", R, "truncated"), ("to reduce the cost of...", R, "truncated"),
    ("(to train the new staff", R, "truncated"), ("Based on the page, the answer is", R, "truncated"), ("$31,", ["$31,654.59"], "truncated"), ("August 8, 19", ["August 8, 1975"], "truncated"),
    ("weil zu wenige Leute den Bogen zurückgeschickt haben und die Straße gesperrt war", R, "other_language"), ("потому что дорога закрыта", R, "other_language"), ("потому что", ["потому что"], None),
    ("to train the new staff before the summer", R, None), ("people returned", R, None), ("7", R, None), ("Dr. W. Vamsomson", ["K. Riemmeal"], None), ("12 December 1999", ["3 May 1981"], None),
    ("because too few people returned the survey form.", R, None), ("According to the page: because too few people returned the survey form", R, None), ("x " * 60_000 + "the end", R, None),
]

CORPUS = [
    ("What is the reason for the change?", "because the road to the plant was closed by snow and the staff had to wait"),
    ("Which items are listed under the heading?", "to train the new staff before the summer and to reduce the cost of the paper"),
    ("Welche Artikel sind unter der Nummer aufgeführt?", "weil die Straße zum Werk wegen Schnee gesperrt war und zu wenige den Bogen zurückgeschickt haben"),
    ("Quel est le titre du tableau de la page ?", "parce que la route de l'usine était fermée par la neige et le personnel a dû attendre"),
    ("¿Cuál es el título de la tabla en la lista?", "porque la carretera a la planta estaba cerrada por la nieve y el personal tuvo que esperar"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, Q, p, r, 1) for i, (p, r, _) in enumerate(CASES)]
    rows += [(1000 + 10 * k + i, q, a, [a], 1) for k in range(5) for i, (q, a) in enumerate(CORPUS)]
    return spark.createDataFrame(rows, KIND)


def test_each_defect(pairs):
    found = {r.question_id: r.defects for r in judged_pairs(pairs).collect()}
    wrong = [(CASES[i][0] and CASES[i][0][:60], CASES[i][2], found[i]) for i in range(len(CASES)) if (found[i][:1] or [None])[0] != CASES[i][2]]
    assert wrong == []
    assert not any(found[i] for i in found if i >= 1000)


def test_language_beside_other_defects(spark, pairs):
    german = "weil zu wenige Leute den Bogen zurückgeschickt haben und die Straße gesperrt war und"
    rows = [(2000, Q, german, R, 1), (2001, Q, "Das lässt sich dem Bild nicht entnehmen.", R, 1), (2002, Q, R[0] + " and", R, 1), (2003, Q, "потому что дорога закрыта", R, 1)]
    found = {r.question_id: r.defects for r in judged_pairs(pairs.unionByName(spark.createDataFrame(rows, KIND))).where("question_id >= 2000").collect()}
    assert found == {2000: ["truncated", "other_language"], 2001: ["refusal", "other_language"], 2002: ["truncated"], 2003: ["other_language"]}


ITALIAN = """Il treno per Bologna parte ogni mattina alle sette.
La biblioteca comunale resterà chiusa durante le vacanze di Natale.
I bambini giocano nel cortile della scuola dopo le lezioni.
Abbiamo comprato delle mele rosse al mercato del paese.
Il direttore ha confermato la data della riunione con i sindacati.
Nessuno dei testimoni ricordava il colore della macchina.
Le finestre del palazzo sono state sostituite due anni fa.
Una giovane pittrice espone i suoi quadri nella galleria di via Garibaldi.
Gli scavi hanno portato alla luce una moneta romana.
Il raccolto di quest'anno è stato danneggiato dalla grandine.
Secondo il medico, il paziente può tornare a casa domani.
Questo formaggio viene prodotto con latte di pecora.""".split("\n")
HOME = """The quarterly figures were discussed at length by the whole committee.
Both bridges across the river had to be repaired after the flood.
She wrote that the samples would arrive before the end of the month.
A thin layer of paint protects the wood from rain.
Ein neuer Brunnen wurde im Garten hinter dem Rathaus gebaut.
Die Lehrerin hat den Kindern eine lange Geschichte vorgelesen.
Im Winter fahren die Busse nur alle zwei Stunden in das Dorf.
Nach dem Umbau ist die Halle doppelt so groß wie vorher.
Le musée de la ville prête chaque été plusieurs tableaux à d'autres villes.
Les voisins se plaignent du bruit que font les camions pendant la nuit.
On ne peut pas visiter la tour quand il y a trop de vent.
Une lettre du ministre annonce la fermeture de la gare.
El puente viejo se cerró al tráfico porque las piedras estaban sueltas.
La cosecha de este año ha sido mejor que la de los dos anteriores.
Los niños de la escuela plantaron un árbol en la plaza.
No se sabe cuándo llegará el próximo barco con las medicinas.""".split("\n")


@pytest.fixture(scope="module")
def fitted(spark, data):
    return fit_languages(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/internvl_error_sample_v1.parquet"))


def test_languages_of_unseen_text(fitted):
    """Sentences that no table holds: every language against every other."""
    asked = {"en": "What is the reason for the change?", "de": "Was ist der Grund für die Änderung und wer ist dafür?", "fr": "Quelle est la raison de la modification et quel est le titre?", "es": "¿Cuál es el motivo del cambio y quién es el autor?"}
    telling = telling_words()
    missed = [(k, x) for k, q in asked.items() for x in ITALIAN if not strange_language(q, x, [], fitted, telling)]
    assert len(missed) <= 0.1 * 4 * len(ITALIAN), missed
    own = [(k, x) for i, (k, q) in enumerate(asked.items()) for x in HOME[4 * i : 4 * i + 4] if strange_language(q, x, [], fitted, telling)]
    assert own == []
    other = [(k, x) for i, (k, q) in enumerate(asked.items()) for j, x in enumerate(HOME) if j // 4 != i and not strange_language(q, x, [], fitted, telling)]
    assert len(other) <= 0.1 * 3 * len(HOME), other


def test_long_beginnings_and_rules_at_their_edges(spark, pairs):
    """No length ends a rule, and every rule that fires is emitted."""
    words = [f"word{i}" for i in range(3000)]
    french = "Quelle est la raison de la modification du tableau ?"
    rows = [
        (3000, Q, " ".join(words[:1500]), [" ".join(words)], 1),
        (3001, french, "I cannot tell what is written on the page and the answer is not given", ["parce que la route était fermée"], 1),
        (3002, Q, "I cannot " + "x" * 22 + " tell", R, 1), (3003, Q, "I cannot " + "x" * 40 + " tell", R, 1),
    ]
    found = {r.question_id: r.defects for r in judged_pairs(pairs.unionByName(spark.createDataFrame(rows, KIND))).where("question_id >= 3000 AND question_id < 4000").collect()}
    assert found == {3000: ["truncated"], 3001: ["refusal", "other_language"], 3002: ["refusal"], 3003: []}


def test_the_sample_is_cut_out_before_any_shuffle(spark, monkeypatch):
    monkeypatch.setattr(answer_defects, "TRAINED_QUESTIONS", 50)
    rows = [(i, q, a, [a], 1) for i in range(400) for q, a in CORPUS[i % 5 : i % 5 + 1]] + [(7, *CORPUS[0], ["x"], 1)] * 50
    table = fit_languages(spark.createDataFrame(rows, KIND))
    assert table["what"][0][0] == "en" and len(table) < 120 and fit_languages(spark.createDataFrame([], KIND)) == {}


def test_every_question_and_every_frequent_word_counts(spark, monkeypatch):
    monkeypatch.setattr(answer_defects, "TRAINED_QUESTIONS", 5)
    rows = [(i, *CORPUS[i % 5], [CORPUS[i % 5][1]], 1) for i in range(400)]
    rows += [(1000 + i, "What is the heading?", "x", ["gleam", None], 1) for i in range(2)] + [(1002, "Was ist der Grund und wer ist dafür?", "x", ["gleam gleam"], 1)] * 9
    table = fit_languages(spark.createDataFrame(rows, KIND).repartition(7))
    assert table["what"] == (("en", 1.0),) and {k for k, _ in table["gleam"]} == {"en", "de"}  # three questions of 403 have it, one of them nine times
    long = [" ".join("".join(chr(97 + k // 26**j % 26) for j in range(3)) + "q" for k in range(7000))]
    assert len(fit_languages(spark.createDataFrame([(i, Q, "x", long, 1) for i in range(3)], KIND))) >= 7000


def test_one_row_per_question_and_edges(spark, pairs):
    again = pairs.withColumn("at", F.lit(0)).withColumn("prediction", F.lit("Unanswerable")).where("question_id = 31")
    nulls = spark.createDataFrame([(None, None, None, None, None), (900, None, "an answer", None, None), (901, "", None, [None], 3), (902, None, "", [], 1)], KIND)
    both = pairs.unionByName(again).unionByName(pairs.limit(5)).unionByName(nulls).withColumn("defects", F.lit("clash")).withColumn("label", F.lit(1)).repartition(5)
    rows = [(r.question_id, r.defect_type) for r in defective_questions(both, delivered=["at", "prediction"]).collect()]
    assert len(rows) == len({q for q, _ in rows})
    found = dict(rows)
    assert found[31] == "refusal" and found[901] == "empty" and found[902] == "empty" and 900 not in found and None not in found
    assert defective_questions(pairs.limit(0), delivered=["at"]).count() == 0


def test_audit_equals_sql(spark, data):
    assert_same(p1_audit(spark, data), connect(data), SQL["p1_audit"])
