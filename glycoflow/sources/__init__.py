"""Where tables come from and go to: storage contract and the driver-table adapter."""
