"""Stemmed search over a whole table against plain Python."""

import re

import pytest

from tessera import queries as base
from tessera.functions import text
from tests.sentences import sentences

SF = "/root/testdata/sf0.001"
PLAIN = {
    "en": [lambda t: t("licensed"), lambda t: t("licensing") and not t("works"), lambda t: (t("rights") or t("foxes")) and not t("reserving"), lambda t: not t("licenses"), lambda t: False],
    "ru": [lambda t: t("license"), lambda t: t("de") and not t("лисы"), lambda t: t("быстрая") or t("la"), lambda t: not t("быстрый"), lambda t: False],
}


@pytest.mark.parametrize("lang", ["en", "ru"])
def test_against_plain_python(spark, lang, tmp_path):
    docs = base.table(spark, SF, "documents").select("doc_id", "text").union(sentences(spark, lang).selectExpr("doc_id + 1000000000", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    norm = {}
    want = []
    for r in docs.collect():
        terms = {norm.setdefault(w, text.normalize_word(w, lang)) for w in re.findall(r"[^\W_]+", r.text or "")}
        has = lambda w: text.normalize_word(w, lang) in terms  # noqa: B023, E731
        want += [(q, r.doc_id) for q, fits in zip(base.TABLE_QUERIES[lang], PLAIN[lang]) if fits(has)]
    got = [tuple(r) for r in base.queries()[f"search_stemmed_table_{lang}"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert len({q for q, _ in got}) >= 3
