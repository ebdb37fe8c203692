"""Training-data operators: quality, deduplication, privacy, tokens, licences, pages, mixing.

Each module holds one operator with its own general interface; ``catalog`` binds them to the
test tables as queries ``opN_<name>``.  Nothing else in the library imports this subpackage.
"""
