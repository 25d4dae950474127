"""Where rows come from and where intermediate tables go."""
