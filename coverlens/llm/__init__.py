"""Operators for building training corpora: near copies, licences, search, token counts, personal
data, toxicity, benchmark leaks, packing, web archives, language-model scores, n-gram joins, centroids
and prefix tries."""
