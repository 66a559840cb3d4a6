"""Text of filings: pages to lines and tables, reporting periods, amounts, sections, sentences and events, each a column function over Arrow batches."""
