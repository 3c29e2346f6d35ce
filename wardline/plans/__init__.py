"""Jobs that chain operators, and the registered queries."""
