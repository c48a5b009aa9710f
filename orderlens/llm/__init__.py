"""Training-data operators over text corpora (documents, pages, benchmark, labels).

Nothing outside this subpackage imports it. Each operator module has a general
function; ``queries`` registers the thin ``opN_<name>`` queries.
"""
