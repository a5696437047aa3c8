"""Views of the test data and the registered queries."""
