"""Fragments of words that ligatures broke."""

from docweave.operators.geometry import joined_fragments, within_word


def part(text, x0, x1, y0=100.0, y1=112.0, **more):
    return {"doc_id": 1, "page_no": 1, "idx": 0, "chunk_type": "text", "text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "confidence": None} | more


def texts(*parts):
    return [p["text"] for p in joined_fragments(list(parts))]


def test_fragments():
    assert texts(part("de", 0.0, 10.0), part("ﬁ", 10.2, 14.0), part("nes", 14.1, 30.0)) == ["deﬁnes"]
    assert texts(part("de", 0.0, 10.0), part("ﬁ", 12.0, 14.0)) == ["de", "ﬁ"]
    assert texts(part("de", 0.0, 10.0), part("ﬁ", 10.2, 14.0, y0=108.0, y1=120.0)) == ["de", "ﬁ"]
    assert texts(part("de ", 0.0, 10.0), part("ﬁ", 10.2, 14.0)) == ["de ", "ﬁ"] and texts(part("de", 0.0, 10.0), part("fi", 10.2, 14.0)) == ["de", "fi"]
    assert texts(part("ﬂ", 0.0, 5.0), part("at", 5.0, 9.0), part("x", 9.0, 12.0)) == ["ﬂat", "x"]
    assert texts(part("de", 0.0, 10.0), part("ﬁ", 10.2, 14.0, page_no=2)) == ["de", "ﬁ"] and texts(part("de", None, 10.0), part("ﬁ", 10.2, 14.0)) == ["de", "ﬁ"]
    (one,) = joined_fragments([part("a", 0.0, 10.0, confidence=0.5), part("ﬁ", 10.0, 14.0, y1=113.0, confidence=0.25)])
    assert (one["x0"], one["x1"], one["y1"], one["confidence"]) == (0.0, 14.0, 113.0, 0.25)
    assert within_word("a", "ﬁ") and within_word("ﬁ", "-") and within_word("-", "ﬁ") and not within_word("ﬁ", " ") and not within_word("a", "b") and not within_word("(", "ﬁ") and joined_fragments([]) == []
