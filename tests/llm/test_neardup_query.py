from lexweave.llm import queries


def test_links_by_exact_signature(monkeypatch):
    asked = []

    class Table:
        def select(self, *_):
            return self

    monkeypatch.setattr(queries, "table", lambda *_: Table())
    monkeypatch.setattr(queries.canonical, "train", lambda *_: None)
    monkeypatch.setattr(queries, "materialize", lambda df: df)
    monkeypatch.setattr(queries.neardup, "near_duplicates", lambda *_, **how: asked.append(how) or (None, None))
    queries._near(None, "")
    assert asked[0].get("signature") == "sets"
