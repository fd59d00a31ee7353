"""All queries of this package; importing the modules registers them."""

from titleloom.llm import contamination, counts, languages, licences, lines, packing, periods, privacy, resampling, scoring, sharding, simhash, sketches  # noqa: F401
from titleloom.llm.common import ORACLES, QUERIES  # noqa: F401
