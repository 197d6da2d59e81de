"""Column lists of the flow tables; fixed values."""

NUM_COLS = [
    "in_bytes", "out_bytes", "in_pkts", "out_pkts", "flow_duration_milliseconds", "duration_in", "duration_out",
    "longest_flow_pkt", "shortest_flow_pkt", "min_ip_pkt_len", "max_ip_pkt_len", "src_to_dst_second_bytes",
    "dst_to_src_second_bytes", "src_to_dst_avg_throughput", "dst_to_src_avg_throughput", "retransmitted_in_bytes",
    "retransmitted_in_pkts", "retransmitted_out_bytes", "retransmitted_out_pkts", "num_pkts_up_to_128_bytes",
    "num_pkts_128_to_256_bytes", "num_pkts_256_to_512_bytes", "num_pkts_512_to_1024_bytes",
    "num_pkts_1024_to_1514_bytes", "min_ttl", "max_ttl", "tcp_win_max_in", "tcp_win_max_out", "dns_ttl_answer",
]
CAT_COLS = [
    "protocol", "tcp_flags", "client_tcp_flags", "server_tcp_flags", "icmp_type", "icmp_ipv4_type",
    "dns_query_type", "ftp_command_ret_code",
]
