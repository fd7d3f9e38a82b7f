"""All registered queries of the training-data operators, and the SQL of those that SQL can express."""

from quarry.llm import ctw, decontaminate, fmindex, lines, minhash, mixing, quality, secrets, sharding, simhash, spelling, suffixes, tries

MODULES = (fmindex, secrets, quality, decontaminate, sharding, mixing, simhash, ctw, lines, suffixes, tries, minhash, spelling)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
