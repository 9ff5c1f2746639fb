"""Where governance metadata, query logs and governed tables come from, and where reports go."""
