"""Notices close together are all found, the one with more edits first or last."""

from stratadiff.llm import licenses


def test_each_of_two_neighbours():
    search = licenses.Search(licenses.NOTICES)
    for text, edits in [("gnu generel public license gnu general public license", [1, 0]), ("gnu general public license gnu generel public license", [0, 1]), ("gnu generel public license gnu general public license gnu genaral public license", [1, 0, 1])]:
        found = licenses.scan(text, search)["spans"]
        assert [(s["first_word"], s["edits"]) for s in found if "gpl" in s["label"].lower() or "gnu" in s["label"].lower()] == [(4 * i, e) for i, e in enumerate(edits)]
