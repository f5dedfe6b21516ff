"""Keyword stuffing: languages that were never seen, regular recurrence, small words learnt from the collection."""

import random

import pytest

from seqloom.llm import stuffing

PROSE = {
    "pl": "Po wyjściu z domu zauważył, że na ulicy nie ma już nikogo. Wrócił więc do pokoju i usiadł przy oknie, z którego widać było rzekę. Nie wiedział, czy to dobry znak, ale postanowił poczekać do rana. Kiedy nad ranem zaczął padać deszcz, wstał i zaparzył sobie herbatę. W kuchni było zimno, a na stole leżał list od brata.",
    "ru": "Когда он вышел из дома, на улице уже никого не было. Тогда он вернулся в комнату и сел у окна, из которого была видна река. Он не знал, хороший ли это знак, но решил подождать до утра. Под утро пошёл дождь, и он встал, чтобы заварить себе чаю. На кухне было холодно, а на столе лежало письмо от брата.",
    "nl": "Toen hij het huis verliet, was er niemand meer op straat. Hij ging dus terug naar zijn kamer en nam plaats bij het raam, waar je de rivier kon zien. Hij wist niet of dat een goed teken was, maar besloot tot de ochtend te wachten. Tegen de ochtend begon het te regenen, en hij zette een pot thee. In de keuken was het koud en op tafel lag een brief van zijn broer.",
    "fi": "Kun hän lähti talosta, kadulla ei ollut enää ketään. Hän palasi siis huoneeseensa ja istuutui ikkunan ääreen, josta näkyi joelle. Hän ei tiennyt, oliko se hyvä merkki, mutta päätti odottaa aamuun asti. Aamulla alkoi sataa, ja hän nousi keittämään teetä. Keittiössä oli kylmä, ja pöydällä oli kirje veljeltä.",
    "cs": "Když vyšel z domu, na ulici už nikdo nebyl. Vrátil se tedy do pokoje a posadil se k oknu, ze kterého bylo vidět na řeku. Nevěděl, jestli je to dobré znamení, ale rozhodl se počkat do rána. K ránu začalo pršet a on vstal, aby si uvařil čaj. V kuchyni bylo chladno a na stole ležel dopis od bratra.",
}
#: As the collection teaches them: no language of PROSE is among them.
ENGLISH = frozenset("the of in and to is a for with from but on by as we at it that be was has".split())


@pytest.mark.parametrize("lang", PROSE)
@pytest.mark.parametrize("small", [None, ENGLISH])
@pytest.mark.parametrize("by_line", [False, True])
def test_prose_of_unknown_languages_is_none(lang, small, by_line):
    text = PROSE[lang].replace(". ", ".\n") if by_line else PROSE[lang]
    assert sum(stuffing.stuffed_share(text, small)) < 0.1


@pytest.mark.parametrize("period", [9, 11, 17, 21])
@pytest.mark.parametrize("small", [None, ENGLISH])
def test_regular_recurrence_at_any_lag(period, small):
    r = random.Random(period)
    words = []
    for _ in range(30):
        words += ["premium", "reagents", *["".join(r.choice("aeioustrnlkm") for _ in range(r.randint(2, 9))) for _ in range(period - 2)]]
    lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
    assert sum(stuffing.stuffed_share(". ".join(x.capitalize() for x in lines) + ".", small)) > 0.5


def test_a_periodic_page_of_long_lines():
    line = "cheap reagents primers plasmids ladders vectors enzymes buffers filters columns for"
    assert sum(stuffing.stuffed_share("\n".join([line] * 50), ENGLISH)) > 0.5


def test_irregular_recurrence_is_none():
    r = random.Random(4)
    words = []
    for _ in range(30):
        words += ["reagents", *["".join(r.choice("aeioustrnlkm") for _ in range(r.randint(4, 9))) if r.random() < 0.7 else "the" for _ in range(r.randint(9, 40))]]
    text = ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, len(words), 12)) + "."
    assert sum(stuffing.stuffed_share(text, ENGLISH)) < 0.3


def test_small_words_are_learnt(spark):
    """Small words are in most texts, evenly; a keyword heaped up in some texts is none, nor is a long word."""
    r = random.Random(2)
    rows = []
    for i in range(60):
        words = [r.choice(["vor", "zu", "mit"]) if r.random() < 0.4 else "".join(r.choice("bdgmstw") for _ in range(6)) for _ in range(60)]
        rows.append((i, " ".join([*words, "Masken", *(["kit"] * 40 if i % 3 == 0 else [])]), "de"))
    rows += [(90, None, "de"), (91, "", "de"), (92, "zu zu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(x) for x in stuffing.small_words(df, "text", "lang").collect()} == {("de", "vor"), ("de", "zu"), ("de", "mit")}
    assert stuffing.small_words(df.limit(0), "text", "lang").collect() == []
    got = stuffing.stuffing(df, "doc_id", "text", "lang").collect()
    assert len(got) == 63 and all(0 <= x.spam_share <= 1 for x in got)


def test_a_wrong_label_changes_nothing(spark):
    """English under the label of another language is judged with English small words."""
    small = {"en": frozenset(w.encode() for w in ENGLISH), "de": frozenset(b"der die das und mit nach von vom ist im auf".split())}
    import pyarrow as pa

    text = "Te.bosto.24 was found on the left arm in 56 copies. It was merged with a longer one by the run of last week. " * 3
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["en", "de", None]), pa.array([text] * 3)], names=["id", "lang", "text"])
    got = next(stuffing._judge(small)(iter([b])))
    assert len({tuple(got.column(i)[j].as_py() for i in range(1, 5)) for j in range(3)}) == 1
