"""Table loading, file discovery, ignore rules, snapshot differences and result sinks."""
