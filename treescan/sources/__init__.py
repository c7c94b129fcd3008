"""Where entries come from: a file system, ledgers, or views over tables."""
