from codestrata.llm import reading as R

EASY = "The cat sat on the mat. It is a big cat. We see the cat and you like it. " * 6
HARD = "Notwithstanding the considerable multidimensional heterogeneity of such epistemological parameterizations, any sufficiently deterministic reconceptualization of the underlying infrastructure necessarily presupposes an indistinguishability which the interdependent characterization, itself irreducible, can neither corroborate nor operationalize in its entirety. " * 4
GERMAN = "Die Katze sitzt auf der Matte und der Hund ist nicht im Haus, weil er mit den Kindern auf die Straße geht. " * 8


def test_syllables():
    for word, n in {"cat": 1, "table": 2, "make": 1, "the": 1, "reading": 2, "configuration": 5, "created": 3, "idea": 3, "moved": 1, "boxes": 2, "well-known": 2}.items():
        assert R.syllables(word) == n, word


def test_grades_order_texts_and_need_english_prose():
    easy, hard = R.reading_grade(EASY), R.reading_grade(HARD)
    assert easy < 4 < 20 < hard
    code = "```go\n" + "x := f(1)\n" * 80 + "```\n"
    tables = "| a | b |\n|---|---|\n" + "| the one | and the other |\n" * 60
    for text in [None, "", "Too short.", GERMAN, code, tables, "graph LR\n" + "  a --> b\n" * 90, " \n\t "]:
        assert R.reading_grade(text) is None
    assert abs(R.reading_grade(code + EASY + "\n" + tables) - easy) < 0.5


def test_layout_does_not_matter():
    words, lines, line = EASY.split(), [], ""
    for w in words:
        if len(line) + len(w) + 1 > 40:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    wrapped = "\n".join([*lines, line])
    base = R.reading_grade(EASY)
    bare = "\n".join(s.strip() for s in EASY.split(".") if s.strip()).lower()
    for text in [wrapped, "> " + wrapped.replace("\n", "\n> "), "\n".join("- " + s for s in EASY.split(". ")), "<p>" + EASY.replace(" the ", "&nbsp;the ") + "</p>", bare, EASY.replace("\n", "\r\n")]:
        assert abs(R.reading_grade(text) - base) < 0.8, text


def test_cuts():
    assert R.fit_cuts([]) == [6.0, 10.0, 16.0]
    assert R.fit_cuts([(1, 1), (2, 1), (8, 2), (9, 2), (20, 3), (21, 3), (30, 4), (31, 4), (9, 1)]) == [5.0, 14.5, 25.5]
    assert R.fit_cuts([(5, 2)] * 3) == [6.0, 10.0, 16.0]


def test_tables(spark):
    rows = [(1, EASY, 0), (2, HARD, 0), (3, None, 0), (4, "", 0), (5, GERMAN, 0), (1, EASY, 0), (None, EASY, 0), (6, EASY * 2000, 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, level int")
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 1, "c"), (2, 4, "a"), (3, 2, "a"), (2, None, "b"), (9, 3, "a")], "doc_id long, level int, rater string")
    levels = {r.doc_id: r.level for r in R.reading_levels(documents, labels).collect()}
    assert set(levels) == {1, 2, 6} and levels[1] == levels[6] == 1 and levels[2] == 4
    unlabelled = {r.doc_id: r.level for r in R.reading_levels(documents, labels.limit(0)).collect()}
    assert unlabelled == {1: 1, 2: 4, 6: 1}
    assert R.reading_levels(documents.limit(0), labels).collect() == []


def test_syllables_of_words_not_looked_at_when_the_patterns_were_written():
    held = dict(
        reader=2, readability=5, document=3, people=2, evaluate=4, continuous=4, employee=3, employer=3, studying=3, flying=2, carrier=3, easier=3, variety=4, society=4, museum=3, poem=2, cooperate=4, chaos=2, actual=3, value=2, fuel=2,
        build=1, question=2, queue=1, layer=2, rhythm=2, organism=4, stages=2, makes=1, changes=2, boxes=2, houses=2, walked=1, started=2, simple=2, whole=1, average=3, important=3, university=5, information=4, experience=4, areas=3, being=2,
        doing=2, media=3, material=4, social=2, ocean=2, region=2, religious=3, serious=3, previous=3, ancient=2, efficient=3, orient=3, client=2, near=1, linear=3, nuclear=3, great=1, eye=1, year=1, young=1, reason=2, ready=2, react=2, reality=4,
        creature=2, influence=3, fluid=2, fruit=1, quality=3, guarantee=3, january=4, mosaic=3, naive=2, archive=2, hyphenation=4, syllable=3, formula=3, sentence=2, difficult=3, education=4, scale=1, agree=2, shoe=1, blue=1, ties=1, tried=1, studies=2,
        engine=2, machine=2, little=2, files=1, rules=1, modules=2, obvious=3, curious=3, idiot=3, librarian=4, comedian=4, suggestion=3, onion=2, triangle=3, diagram=3, appreciate=4, negotiate=4, associate=4, theory=3, geology=4, dinosaur=3, cruel=2,
    )
    wrong = [w for w, n in held.items() if R.syllables(w) != n]
    assert len(wrong) <= 0.06 * len(held), wrong
