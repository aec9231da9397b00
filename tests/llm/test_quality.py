import os
import random

import numpy as np
import pytest

from caseloom.llm import quality, queries_documents
from caseloom.llm.prose_kernel import STATISTICS, statistics, vocabulary
from caseloom.llm.quality import common_words, text_quality

DIR = "/root/testdata/sf0.01"
NOUNS = "court claim witness order notice tariff lease harbour vessel clerk duty appeal record".split()
VERBS = "held dismissed received considered amended refused described".split()
LINKS = "after the|before any|with the|because of the|in light of an|and not the".split("|")
FR = ("la cour le tribunal la demande le contrat le témoin la règle".split(" "), "a rejeté|a examiné|confirme|ne permet pas".split("|"), "en raison du|à l'égard de la|selon le".split("|"))


def sentence(rng, french=False):
    if french:
        subject, verb, link = FR
        if rng.random() < 0.4:
            return f"Le {rng.randint(1, 28)} mai {rng.randint(1960, 2020)}, le tribunal {rng.choice(verb)} la demande {rng.choice(link)} {rng.choice(NOUNS)}."
        return f"La {rng.choice(NOUNS)} {rng.choice(verb)} le {rng.choice(NOUNS)} {rng.choice(link)} {rng.choice(NOUNS)}.".replace("La court", "La cour")
    if rng.random() < 0.4:
        return f"{rng.choice(['On March', 'In May', 'By June'])} {rng.randint(1, 28)}, {rng.randint(1960, 2020)}, the {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(LINKS)} {rng.choice(NOUNS)}."
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)} that {rng.choice(NOUNS)} {rng.choice(LINKS)} {rng.choice(NOUNS)} {rng.choice(LINKS)} {rng.choice(NOUNS)}."


def prose(rng, french=False):
    text = [sentence(rng, french) for _ in range(rng.randint(6, 16))]
    kind = rng.random()
    if kind < 0.2:  # wrapped
        words, lines = " ".join(text).split(), []
        while words:
            lines.append(" ".join(words[:8]))
            words = words[8:]
        return "\n".join(lines)
    if kind < 0.3:
        return "\n".join(f"[{i}] {s}" for i, s in enumerate(text, 1))
    if kind < 0.4:
        return "\n".join(("Q. ", "A. ")[i % 2] + s for i, s in enumerate(text))
    return (" " if kind < 0.8 else "\n\n").join(text).upper() if kind > 0.97 else " ".join(text)


def other(rng):
    kind, n = rng.randrange(6), rng.randint(10, 30)
    noun = lambda: rng.choice(NOUNS)
    if kind == 0:
        return "\n".join(f"- {noun()} {noun()}" for _ in range(n))
    if kind == 1:
        return "\n".join(f"AB-{rng.randint(10, 99)};{noun().title()};20{rng.randint(10, 24)}-02-03;{rng.randint(1, 999)};paid" for _ in range(n))
    if kind == 2:
        return "\n".join(f"{noun().title()} {'.' * rng.randint(10, 40)} {rng.randint(1, 400)}" for _ in range(n))
    if kind == 3:
        return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 12))) for _ in range(3 * n))
    if kind == 4:
        return "\n".join(f"The {noun()} of the {noun()}" for _ in range(n))
    return "#" * 20 * n


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    data = [(i, prose(rng), rng.choice(["en", "en", "EN ", "eng", None, "fr"] if i % 9 == 0 else ["en"])) for i in range(400)]
    data += [(1000 + i, prose(rng, True), "fr") for i in range(120)]
    return data + [(2000 + i, other(rng), "en") for i in range(110)]


def test_operator(spark, corpus):
    extra = [(3000, None, "en"), (3001, "", "en"), (3002, "  \n", None), (0, *corpus[0][1:])]
    df = spark.createDataFrame([(i, t, g, "x", 1.0) for i, t, g in corpus + extra], "doc_id bigint, text string, lang string, language string, distance double")
    out = text_quality(df, "doc_id", "text", "lang").collect()
    assert len(out) == len(corpus) + 1
    found, true = {r.doc_id for r in out if r.unprosaic}, {i for i, _, _ in corpus if i >= 2000}
    assert true <= found and len(found - true) <= 10
    assert sum(r.language == "fr" for r in out if 1000 <= r.doc_id < 2000) > 110
    for r in out:
        assert abs(sum(r[f"of_{s}"] for s in STATISTICS) - r.distance) < 1e-6 * max(1, r.distance)
    assert text_quality(df.limit(0), "doc_id", "text", "lang").count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_no_single_statistic_decides(spark):
    """On the documents of the test tables no statistic, cut at any value, says what the distance does."""
    out = queries_documents.p8_statistics(spark, DIR).collect()
    bad = np.array([r.unprosaic for r in out])
    assert 0.1 < bad.mean() < 0.4
    for s in STATISTICS:
        x = np.array([r[s] for r in out])
        for cut in np.unique(x):
            for side in (x > cut, x < cut):
                assert not np.array_equal(bad, side)


def test_all_prose_and_few_rows(spark, corpus):
    """Without junk the cutoff is that of chi-squared; a corpus too small for any language is compared with itself."""
    df = spark.createDataFrame([r for r in corpus if r[0] < 1000], "doc_id bigint, text string, lang string")
    out = text_quality(df, "doc_id", "text", "lang").collect()
    assert sum(r.unprosaic for r in out) < 0.1 * len(out)
    few = text_quality(df.where("doc_id < 12"), "doc_id", "text", "lang").collect()
    assert len(few) == 12 and all(np.isfinite(r.distance) for r in few)


def test_a_rare_language_is_compared_in_shape(spark, corpus):
    rare = "Суд отклонил иск, так как срок был пропущен. Решение суда было оставлено в силе, и жалоба не была принята. Ответчик не явился в суд без причины."
    df = spark.createDataFrame(corpus + [(5000, rare, "ru"), (5001, "- суд\n- иск\n- срок\n- дело\n- мера\n- лицо\n- долг\n- право", "ru")], "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in text_quality(df, "doc_id", "text", "lang").where("doc_id >= 5000").collect()}
    assert out[5000].language == "ru" and out[5000].of_common == 0 and out[5000].distance < out[5001].distance


def test_common_words_come_from_the_corpus(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string")
    speaking = common_words(df, "text", "lang")
    assert "en" in speaking["that"] and "fr" in speaking["le"] and "xkdz" not in speaking
    assert sum("en" in of for of in speaking.values()) <= quality.COMMON


def test_statistics():
    speaking = {"the": ("en",), "of": ("en",), "le": ("fr",)}
    names = dict(zip(STATISTICS, range(len(STATISTICS))))
    lang, wrapped = statistics("The claim of the\ncourt was late. It was\ndismissed.", speaking)
    _, flat = statistics("The claim of the court was late. It was dismissed.", speaking)
    assert lang == "en" and np.allclose(wrapped, flat) and flat[names["ending"]] == 1.0 and flat[names["common"]] == 0.3
    assert statistics("THE CLAIM OF THE\nCOURT WAS LATE.", speaking)[1][names["line_words"]] == pytest.approx(np.log(7))
    assert statistics("One\nTwo\nThree", speaking)[1][names["ending"]] == 0.0 and statistics("Done. Cut off in the", speaking)[1][names["ending"]] == 1.0
    assert statistics(" \n​\t", speaking) is None and statistics("!", speaking)[0] == ""
    assert statistics("1 2 3", speaking)[1][names["digits"]] == 1.0
    assert vocabulary("The l'été 42 法") == {"the", "été", "法"}
