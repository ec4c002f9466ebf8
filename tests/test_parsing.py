from docweave.operators.parsing import has_repeated_content, is_table_text, numeric_tokens, parse_records, signature, split_text, top_level_objects, unfenced


def test_records():
    ok = '[{"bbox_2d": [1, 2.5, 3, 3.5], "text_content": " a "}, {"bbox": [1,2,3,4], "text": "b", "type": "KV"}]'
    assert parse_records(ok) == [(1, 2, 3, 4, "a", None), (1, 2, 3, 4, "b", "kv")]
    assert parse_records("```json\n" + ok + "\n```") == parse_records(ok)
    assert parse_records(ok[:-20]) == [(1, 2, 3, 4, "a", None)]
    assert parse_records('[{"bbox": [1,2,true,4], "text": "x"}, {"bbox": [1,2,3], "text": "x"}, {"bbox": [1,2,3,4]}]') == []
    assert parse_records(r'x {"bbox": [1,2,3,4], "text": "a\d"}') == [(1, 2, 3, 4, r"a\d", None)]
    assert parse_records(None) == parse_records("") == parse_records("prose") == []
    assert list(top_level_objects('{"a": "}"} {"b": {"c": 1}} {"d"')) == ['{"a": "}"}', '{"b": {"c": 1}}']
    assert unfenced("a") == "a"


def test_text():
    assert is_table_text("a | b\n--- | ---\n1 | 2") and not is_table_text("a | b\n1 | 2")
    assert numeric_tokens("a1 12.5% 1,000.00, x-3 (7) 2024-01-02.") == ["12.5%", "1,000.00", "3", "7", "2024-01-02"]
    assert numeric_tokens("5mg 10kg 3.5x HbA1c +7% 1/2, -") == ["5", "10", "3.5", "+7%", "1/2"]
    assert has_repeated_content("x " * 18) and not has_repeated_content("x " * 17)
    assert has_repeated_content("a b c " * 8) and not has_repeated_content("a b c " * 7)
    assert not has_repeated_content("| " * 100) and not has_repeated_content(None)
    assert signature(b"k", "1", 2, "b").startswith("v1,")
    text = "One two. Three four. Five\nsix"
    parts = split_text(text, 12)
    assert [text[a:b] for a, b in parts] == ["One two.", "Three four.", "Five\nsix"]
