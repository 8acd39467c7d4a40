"""Operations of a training-data pipeline: deduplication, language, quality and safety scores, output.

Nothing else in the library imports this subpackage.  Every operator has its own module with a general
interface; ``queries.py`` holds the thin registered ``opN_<name>`` queries and ``sql.py`` their oracles.
"""
