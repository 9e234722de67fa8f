"""Column functions: text, envelopes, paging, scoring."""
