"""Table scans, integer series and change-message sources."""
