"""Contest analytics on Spark: strict-time history, market probabilities, scoring and selection.

Every operator takes and returns DataFrames.  Vocabulary: *contest* (one race),
*subject* (one competitor over time), *entry* (a subject in a contest), *field*
(all actual starters), *card* (one venue-day), *panel* (entry-level features),
*label* (finished in the first three places).
"""
