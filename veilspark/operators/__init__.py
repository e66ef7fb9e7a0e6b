"""DataFrame operators: registry, matching, redaction, pages, corpus, reports."""
