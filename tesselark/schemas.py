"""Explicit schemas as DDL; nothing is inferred. Unsigned 32-bit ids are longs."""

from __future__ import annotations

PAGE = "id long, title string, text string"
REDIRECT = "title string, redirect string"
TITLE = "id long, title string"
GENDER = "id long, gender string"
LINKS = "id long, links array<long>"
RANK = "id long, pagerank double"
CATEGORIES = "id long, categories array<long>"
WORD_COUNT = "word string, count long"
DICTIONARY = "ordinal long, word string"
WORD_BAG = "id long, title string, words array<struct<word:long,count:long>>"
CLASSIFIED = "id long, classification int"
ENTITY = "id long, wikidata_id string, title string, claims map<string,array<struct<value:string,rank:string>>>"
#: One page of an XML dump.
DUMP_PAGE = "title string, ns int, id long, redirect struct<_title:string>, revision struct<text:string>"
#: One line of an entity dump; values are kept as JSON text.
RAW_ENTITY = (
    "id string, sitelinks map<string,struct<site:string,title:string,url:string>>, claims map<string,array<struct<mainsnak:struct<property:string,datavalue:struct<value:string>>,rank:string>>>"
)
#: Namespaces of pages.
NAMESPACES = {
    0: "Article", 1: "Talk", 2: "User", 3: "User talk", 4: "Project", 5: "Project talk", 6: "File", 7: "File talk", 8: "MediaWiki", 9: "MediaWiki talk",
    10: "Template", 11: "Template talk", 12: "Help", 13: "Help talk", 14: "Category", 15: "Category talk", 100: "Portal", 101: "Portal talk",
    118: "Draft", 119: "Draft talk", 710: "TimedText", 711: "TimedText talk", 828: "Module", 829: "Module talk",
}
