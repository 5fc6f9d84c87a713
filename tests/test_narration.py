"""Narration from checked texts to one file, and a run that goes on where it was broken off."""

import base64
import json
import wave

import pytest

from leafmill.ext import clients
from leafmill.operators import contracts
from leafmill.streaming import narration


class Transport:
    """Two frames a sign; refuses texts that hold a word, where one is given."""

    def __init__(self, refused=None):
        self.refused = refused

    def __call__(self, request):
        if "voices" in request:
            return clients.Reply(200, {}, {"voices": ["v"]})
        if self.refused and self.refused in request["text"]:
            return clients.Reply(402)
        return clients.Reply(200, {}, {"frames": base64.b64encode(b"\1\0" * 2 * len(request["text"])).decode()})


#: No two chunks of it are the same, so that each has a sound of its own.
LONG = " ".join(f"bé{k}." for k in range(900))


def book(spark):
    source = spark.createDataFrame([(1, 1, "h1", "One"), (1, 2, "p1", "a[[FN:n1]]"), (2, 3, "h2", "Two"), (2, 4, "p2", "b " * 1500)], "chapter_no int, ord int, id string, text string")
    final = spark.createDataFrame([("h1", "Jedna"), ("p1", "á[[FN:n1]]"), ("h2", "Dvě"), ("p2", LONG)], "id string, text string")
    bodies = spark.createDataFrame([("n1", 1, 1, "note"), ("n2", 2, 9, "free")], "note_id string, note_ord int, source_page int, text string")
    pages = spark.createDataFrame([(1, 1), (2, 2)], "chapter_no int, page_no int")
    titles = spark.createDataFrame([(1, "Jedna")], "chapter_no int, title string")
    return source, final, bodies, pages, titles


def voice_of(mode, refused=None):
    return lambda: clients.Voice(Transport(refused), mode, "v", clients.Patience(sleep=lambda s: None))


@pytest.mark.parametrize("mode, n", [("advanced", 5), ("normal", 3)])
def test_narrate(spark, tmp_path, mode, n):
    source, final, bodies, pages, titles = book(spark)
    args = (source, final, bodies, pages, titles, "B")
    with pytest.raises(contracts.ContractError):
        narration.narrate(*args, mode, voice_of(mode, "free"), str(tmp_path), 1)
    assert not (tmp_path / "book.wav").exists()
    done = spark.read.parquet(str(tmp_path / "sounds")).count()
    assert done == n - 1
    sounds = narration.narrate(*args, mode, voice_of(mode), str(tmp_path), 2).collect()
    assert len(sounds) == n and spark.read.parquet(str(tmp_path / "sounds")).count() == n
    said = [json.loads(r.text)["text"] for r in sorted(sounds, key=lambda r: (r.chapter_no, r.number))]
    assert said[0] == "Jedna á Poznámka: note" and said[-1].endswith("Poznámka: free")
    assert " ".join(said[1:]) == f"Dvě {LONG} Poznámka: free"
    sides = {json.loads(r.text).get("previous_text") for r in sounds if r.number}
    assert sides == {""} if mode == "normal" else all(len(s) == 100 for s in sides)
    with wave.open(str(tmp_path / "book.wav")) as reader:
        assert reader.getnframes() == sum(2 * len(s) for s in said)
    chapters = json.loads((tmp_path / "chapters.json").read_text())
    assert [c["title"] for c in chapters["chapters"]] == ["Jedna", "2"]
    assert chapters["chapters"][1]["start_ms"] == chapters["chapters"][0]["end_ms"] == round(1000 * 2 * len(said[0]) / 24000)
    assert (tmp_path / "chapters.txt").read_text().count("[CHAPTER]") == 2


def test_only_whole_translations_are_read(spark):
    source, final, *_ = book(spark)
    with pytest.raises(contracts.ContractError):
        narration.checked(source, final.where("id <> 'p2'"))
    with pytest.raises(contracts.ContractError):
        narration.checked(source.unionByName(source), final)
    with pytest.raises(contracts.ContractError):
        narration.checked(source.limit(0), final.limit(0))


def test_a_voice_that_is_missing_costs_nothing(spark, tmp_path):
    source, final, bodies, pages, titles = book(spark)
    absent = lambda: clients.Voice(Transport(), "normal", "other", clients.Patience(sleep=lambda s: None))
    with pytest.raises(clients.Failure):
        narration.narrate(source, final, bodies, pages, titles, "B", "normal", absent, str(tmp_path), 1)
    assert not (tmp_path / "sounds").exists()
