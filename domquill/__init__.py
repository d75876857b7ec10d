"""Queries over semi-structured web content, planned by Spark: pages as node tables, selectors as
DataFrame plans, feeds, and the text, address, time, list and map functions that go with them."""
