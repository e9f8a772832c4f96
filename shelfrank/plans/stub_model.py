"""A stand-in for a model, for the registered queries and tests."""

from __future__ import annotations

import json


def stub_annotator(prompt: str) -> str:
    """Deterministic replies to the prompts of ``operators/annotate.py``.

    Items come from the prompt's ``ITEMS_JSON:`` array. The reply stands in
    chat or a fence (by the number of items), has a number element, commas
    before closing brackets, also inside a string (where they must stay),
    omits ``acao`` on every third item, and repeats the first product at the
    end (so "last wins" is exercised).
    """
    items = []
    for ln in prompt.splitlines():
        if ln.startswith("ITEMS_JSON: "):
            for it in json.loads(ln[len("ITEMS_JSON: "):]):
                items.append({"produto": it["produto"],
                              "kind": it.get("tipo") or it.get("classe") or ""})
    abc = "analise" in prompt.rsplit("keys", 1)[-1]
    out = []
    for i, it in enumerate(items, 1):
        if abc:
            if i % 15 == 3:
                continue  # no entry -> "Análise indisponível", not cached
            out.append({"produto": it["produto"], "analise": f"Classe {it['kind']} item {i}"})
        else:
            o = {"produto": it["produto"], "diagnostico": f"{it['kind']} #{i}"}
            if i % 3:
                o["acao"] = "manter"
            out.append(o)
    if items and not abc:
        out.append({"produto": items[0]["produto"], "diagnostico": "revisado [a, ]", "acao": "rever"})
    body = ", ".join(json.dumps(o, ensure_ascii=False)[:-1] + " , }" for o in out)
    if len(items) % 2:
        return "Here is the list:\n[7, " + body + ",\n]\nAnything else?"
    return "```json\n[7, " + body + ",\n]\n```"
