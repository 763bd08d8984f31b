"""The queries of this subpackage and their SQL, gathered from its modules."""

from . import abuse, components, consensus, encodings, leaks, linkage, lookalikes, names, overlap, tokens

QUERIES: dict = {}
ORACLES: dict = {}
for module in (consensus, overlap, linkage, components, lookalikes, names, encodings, tokens, leaks, abuse):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
