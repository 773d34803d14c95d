"""Four sentences a language, queries over them under its stemmer, and the ids that these find."""

from tessera.operators.postings import postings
from tessera.plans.search import search

DOCS = {
    "en": ["The quick brown fox jumps over the lazy dog", "A quick brown dog outpaces a quick fox", "Lazy dogs sleep all day", "Foxes are quick and clever"],
    "ru": ["Быстрая коричневая лиса прыгает через ленивую собаку", "Быстрая коричневая собака обгоняет быструю лису", "Ленивые собаки спят весь день", "Лисы быстры и хитры"],
}
QUERIES = {
    "en": {"quick": [1, 2, 4], "fox": [1, 2, 4], "dog": [1, 2, 3], "lazy": [1, 3], "quick AND fox": [1, 2, 4], "quick OR lazy": [1, 2, 3, 4], "quick AND NOT dog": [4], "fox AND dog": [1, 2], "the": []},
    "ru": {"быстрый": [1, 2, 4], "лиса": [1, 2, 4], "собака": [1, 2, 3], "ленивый": [1, 3], "быстрый AND лиса": [1, 2, 4], "быстрый OR ленивый": [1, 2, 3, 4], "быстрый AND NOT собака": [4], "лиса AND собака": [1, 2], "и": [], "день": [3]},
}


def sentences(spark, lang):
    return spark.createDataFrame(list(enumerate(DOCS[lang], 1)), "doc_id long, text string")


def found(spark, lang, query):
    docs = sentences(spark, lang)
    return sorted(r[0] for r in search(postings(docs, lang), docs, query, lang).collect())
