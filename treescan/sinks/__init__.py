"""Where rows go: text, CSV, slices, ledgers."""
